"""Benchmark passages in training documents, by a distributed positional inverted index.

``build_index`` stores, per document, the sorted positions of each benchmark term that it
holds; the tasks' parts together are the index, kept as Parquet in the shared folder. Terms
of no benchmark item are in no window and have no postings. ``search`` takes the windows
term by term from the rarest in the whole corpus: it shifts each posting list by the term's
offset and intersects, so most windows end after one or two short lists. With ``slop`` each
term may stand that many words off its place: proximity matches in place of exact phrases.

Equal item texts are searched once, whatever items have them. The distinct texts are taken in
slices of about ``MOST_BYTES``, cut where their running sum passes it, as the driver and each
task hold a slice's windows, which take some 350 times that; a larger benchmark takes more
passes. A single text above that is a slice of its own. Item ids stay in a table, which is
joined to the texts found.

Null texts have no words, and items without words no window. Words in windows of an item with a
null id are hit like any other; such items, having no name, are in no list or count of items.
Repeated items count once. Repeated documents keep a row each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import keyed, same_row
from linewright.plans.durable import durable
from linewright.plans.keys import key_struct
from linewright.plans.running import in_pieces, sum_before

WINDOW = 13
# A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
MOST_BYTES = 1 << 20

# ASCII characters outside words become spaces, A-Z become a-z.
IN_WORD = bytes(
    ord(c) if c.isalnum() else 32 for c in (chr(i).lower() for i in range(128))
) + bytes(range(128, 256))


def words(text: bytes) -> list[bytes]:
    return text.translate(IN_WORD).split()


def windows(items: list[tuple[int, bytes]]) -> dict[tuple[bytes, ...], set[int]]:
    """Windows of 13 words, or a shorter item's all, with the texts that hold them."""
    found: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    for item, text in items:
        terms = words(text)
        for at in range(max(1, len(terms) - WINDOW + 1) if terms else 0):
            found[tuple(terms[at : at + WINDOW])].add(item)
    return found


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, text_key, n_words, terms, ends, positions)`` for each row of ``docs``,
    stored: the terms' postings stand one after the other in ``positions``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                counts, lists = [], ([], [], [])
                for text in part.column(2).cast(pa.binary()):
                    tokens = words(text.as_py())
                    ids = np.fromiter(
                        map(vocabulary.get, tokens, repeat(-1)), np.int32, len(tokens)
                    )
                    held = np.flatnonzero(ids >= 0)
                    order = np.argsort(ids[held], kind="stable")
                    terms, sizes = np.unique(ids[held], return_counts=True)
                    counts.append(len(tokens))
                    for values, to in zip((terms, sizes.cumsum(), held[order]), lists, strict=True):
                        to.append(values.astype(np.int32))
                arrays = [
                    pa.ListArray.from_arrays(
                        np.cumsum([0, *map(len, parts)]).astype(np.int32), np.concatenate(parts)
                    )
                    for parts in lists
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64()), *arrays],
                    names=["doc_id", "text_key", "n_words", "terms", "ends", "positions"],
                )

    schema = (
        f"doc_id {id_type}, text_key long, n_words long, "
        "terms array<int>, ends array<int>, positions array<int>"
    )
    return durable(docs.mapInArrow(run, schema))


def meeting(starts: np.ndarray, postings: np.ndarray, offset: int, slop: int) -> np.ndarray:
    """The starts for which a posting lies within ``slop`` of start + offset."""
    low = np.searchsorted(postings, starts + (offset - slop))
    high = np.searchsorted(postings, starts + (offset + slop), side="right")
    return starts[low < high]


def search(
    index: DataFrame,
    vocabulary: dict[bytes, int],
    phrases: dict[tuple[bytes, ...], set[int]],
    slop: int = 0,
) -> DataFrame:
    """``(doc_id, text_key, n_words, hits, items)``: the positions of the words in the
    windows that occur, and the numbers of the texts that these belong to."""
    spread = {
        row["term"]: row["count"]
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    }  # one row per term of the vocabulary at most
    led: dict[int, list] = defaultdict(list)
    for phrase, items in phrases.items():
        terms = [vocabulary[term] for term in phrase]
        if all(term in spread for term in terms):
            order = sorted(range(len(terms)), key=lambda at: (spread[terms[at]], at))
            steps = [(terms[at], at) for at in order]
            led[steps[0][0]].append((steps, len(terms), sorted(items)))
    leads = np.array(sorted(led), np.int32)
    id_type = index.schema["doc_id"].dataType.simpleString()

    def matches(terms, ends, positions):
        begins = np.concatenate(([0], ends))[: len(ends)].astype(np.int64)
        places = {t: (a, b) for t, a, b in zip(terms.tolist(), begins, ends, strict=True)}
        for lead in np.intersect1d(terms, leads, assume_unique=True).tolist():
            for steps, length, items in led[lead]:
                starts = None
                for term, offset in steps:
                    if term not in places:
                        starts = np.zeros(0, np.int64)
                        break
                    a, b = places[term]
                    if starts is None:
                        starts = positions[a:b].astype(np.int64) - offset
                    else:
                        starts = meeting(starts, positions[a:b], offset, slop)
                    if not len(starts):
                        break
                if len(starts):
                    yield starts, length, items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns = [part.column(at) for at in (3, 4, 5)]
            n_words = part.column(2).to_pylist()
            hits, found = [], []
            bounds = [column.offsets.to_numpy() for column in columns]
            values = [column.values.to_numpy() for column in columns]
            for at in range(part.num_rows):
                lists = [v[b[at] : b[at + 1]] for v, b in zip(values, bounds, strict=True)]
                hit, items = set(), set()
                for starts, length, owners in matches(*lists):
                    items.update(owners)
                    spots = (starts[:, None] + np.arange(length)).ravel()
                    hit.update(spots[(spots >= 0) & (spots < n_words[at])].tolist())
                hits.append(sorted(hit))
                found.append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(at) for at in range(3)],
                    pa.array(hits, pa.list_(pa.int32())),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_words", "hits", "items"],
            )

    schema = f"doc_id {id_type}, text_key long, n_words long, hits array<int>, items array<long>"
    return index.mapInArrow(run, schema)


def sliced(items: DataFrame, most_bytes: int) -> DataFrame:
    """``(number, slice, text)`` of the distinct texts of ``items``, in slices of about
    ``most_bytes``."""
    texts = items.select("text").distinct().withColumn("all", F.lit(0))
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    pieces = in_pieces(hashed, "all", ["hash", "text"])
    summed = sum_before(pieces, "all", F.octet_length("text"), "before")
    number = F.col("__at").alias("number")
    return durable(summed.select(number, F.expr(f"before div {most_bytes}").alias("slice"), "text"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, slop: int = 0, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """``(doc_id, text_key, n_words, hits, items, contaminated)`` per row of ``docs``."""
    rows = keyed(docs, "doc_id", "text")
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")
    ).where("text is not null")
    texts = sliced(items, most_bytes)
    slices = [row[0] for row in texts.select("slice").distinct().orderBy("slice").collect()]
    parts = []
    for at in slices or [0]:
        part = texts.where(F.col("slice") == at).collect()  # bounded as said above
        phrases = windows([(row["number"], row["text"].encode()) for row in part])
        terms = sorted({term for phrase in phrases for term in phrase})
        vocabulary = {term: number for number, term in enumerate(terms)}
        parts.append(durable(search(build_index(rows, vocabulary), vocabulary, phrases, slop)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    merged = found.groupBy("doc_id", "text_key").agg(
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("n_rows"),
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
    )
    named = texts.join(items.where("item is not null"), "text").select("number", "item")
    owned = found.where(F.size("items") > 0).select(
        key_struct(["doc_id", "text_key"]).alias("row"), F.explode("items").alias("number")
    )
    lists = (
        owned.distinct()
        .join(named, "number")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    every = merged.join(lists, key_struct(["doc_id", "text_key"]) == F.col("row"), "left")
    one_each = every.withColumn("row", F.explode(F.expr("sequence(1, n_rows)")))
    n_hit = F.size("hits").cast("long")
    return one_each.select(
        "doc_id",
        "text_key",
        "n_words",
        "hits",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    bad = contamination(docs, benchmark).where("contaminated").select("doc_id", "text_key")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        "doc_id",
        F.xxhash64(body).alias("text_key"),
    )
    return rows.join(bad, same_row(rows, bad), "left_anti").select("row.*")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
