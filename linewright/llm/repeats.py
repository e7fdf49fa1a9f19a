"""Passages that repeat, word for word, found in prefix-partitioned suffix trees.

A suffix is a passage's words from a start to 35 words on; a start whose 35 words also start
elsewhere is an internal node of depth 35 in the tree of all suffixes. To build that tree in
parts that fit in a task's memory, suffixes are partitioned by a prefix of variable length
that the content alone decides:

* Each window of 35 words is filed under the eight words in it whose hash is smallest, its
  anchor. Equal windows have equal anchors, and neighbouring windows mostly share one, so
  there are about 14 times fewer anchors than windows.
* Anchors that occur once cannot hold a repeat; they are dropped before any text moves.
* For the others the windows under one anchor travel as one piece of text, copies in a task
  being merged first. An anchor that occurs more than ``CROWDED`` times is too large for a
  group: its windows are filed under all their 35 words instead.

Each group sorts its suffixes; neighbours equal over 35 words form a deep node, so every
comparison is of the words themselves. Runs of such starts are the maximal repeats.

A null text has no words. Documents of fewer than 35 words keep all of them. Two rows with
one id and text are two documents, each the other's copy.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import batch, grouped, join_counted, keyed, same_row, slices

WINDOW = 35
ANCHOR = 8
CROWDED = 20_000

# Odd multipliers, one per word of an anchor.
FACTORS = [
    np.uint64((0x9E3779B97F4A7C15 * (2 * at + 1) ** 3 | 1) % (1 << 64)) for at in range(ANCHOR)
]
PLACE_BITS = np.uint64(24)
PLACE = np.uint64((1 << 24) - 1)
MOST_WORDS = 1 << 23


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    held = 1
    while 2 * held <= width:
        values = np.minimum(values[:-held], values[held:])
        held *= 2
    rest = width - held
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(tokens: list[bytes], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """``(hash, first window, last window)`` of each anchor of a text."""
    ids = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    found: list[tuple[int, int, int]] = []
    # Long texts go in stretches, so that places fit in 24 bits; an anchor cut by a border
    # comes twice, with the windows of either side.
    for base in range(0, len(ids) - window + 1, MOST_WORDS):
        part = ids[base : base + MOST_WORDS + window - 1]
        size = len(part) - ANCHOR + 1
        grams = np.zeros(size, np.uint64)
        for at, factor in enumerate(FACTORS):
            grams += (part[at : at + size] ^ (part[at : at + size] << np.uint64(31))) * factor
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
        ranked = (grams & ~PLACE) | np.arange(size, dtype=np.uint64)
        places = (_sliding_least(ranked, window - ANCHOR + 1) & PLACE).astype(np.int64)
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1))
        lasts = np.concatenate((firsts[1:], [len(places)])) - 1
        spots = places[firsts]
        hashes = grams[spots].view(np.int64)
        found += zip(
            hashes.tolist(),
            (base + firsts).tolist(),
            (base + lasts).tolist(),
            strict=True,
        )
    return found


def repeated_starts(pieces: list[tuple[int, bytes, int]], window: int = WINDOW) -> list[list[int]]:
    """For each piece ``(windows, text, copies)``, the windows that also start elsewhere.

    The suffixes of all pieces in order are the leaves of their tree from left to right;
    leaves that share ``window`` words meet in a node that deep.
    """
    found: list[list[int]] = [[] for _ in pieces]
    suffixes = []
    for at, (n_windows, text, _) in enumerate(pieces):
        tokens = text.split(b" ")
        ends = np.fromiter(map(len, tokens), np.int64, len(tokens)).cumsum()
        ends = (ends + np.arange(len(tokens))).tolist()
        start = 0
        for number in range(n_windows):
            suffixes.append((text[start : ends[number + window - 1]], at, number))
            start = ends[number] + 1
    suffixes.sort()
    low = 0
    while low < len(suffixes):
        high = low + 1
        while high < len(suffixes) and suffixes[high][0] == suffixes[low][0]:
            high += 1
        if high - low > 1 or pieces[suffixes[low][1]][2] > 1:
            for _, at, number in suffixes[low:high]:
                found[at].append(number)
        low = high
    return [sorted(numbers) for numbers in found]


def _ranges(starts: list[int], window: int) -> Iterator[tuple[int, int]]:
    """Spans of words that windows at the sorted ``starts`` cover, merged where adjoining
    starts follow each other."""
    first = last = None
    for start in starts:
        if last is None or start > last + 1:
            if last is not None:
                yield first, last + window
            first = start
        last = start
    if last is not None:
        yield first, last + window


def repeated_spans(
    rows: DataFrame, window: int = WINDOW, crowded: int = CROWDED
) -> DataFrame:
    """``(doc_id, text_key, start, end)``: words covered by a repeated window, end exclusive.

    ``rows`` come from ``keyed``.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    id_field = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(id_type)
    if id_field is None:
        raise TypeError(f"ids must be long, int or string, not {id_type}")

    def list_anchors(batches):
        for part in batches:
            keys, ids, texts_, packed = [], [], [], []
            for doc_ids, text_keys, texts in slices([part]):
                for doc_id, text_key, text in zip(doc_ids, text_keys, texts, strict=True):
                    tokens = text.split()
                    if len(tokens) < window:
                        continue
                    for key, first, last in anchors(tokens, window):
                        keys.append(key)
                        packed.append(first << 8 | (last - first))
                    new = len(keys) - len(ids)
                    ids += [doc_id] * new
                    texts_ += [text_key] * new
                if len(keys) > 100_000:
                    yield batch(listed, keys, ids, texts_, packed)
                    keys, ids, texts_, packed = [], [], [], []
            yield batch(listed, keys, ids, texts_, packed)

    listed = pa.schema(
        [("key", pa.int64()), ("doc_id", id_field), ("text_key", pa.int64()), ("at", pa.int64())]
    )
    schema = f"key long, doc_id {id_type}, text_key long, at long"
    every = rows.mapInArrow(list_anchors, schema)
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = join_counted(every, shared, "key").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("at", "key", (F.col("n") > crowded).alias("hot"))).alias("anchors")
    )
    member = pa.struct([("doc_id", id_field), ("text_key", pa.int64()), ("first", pa.int64())])
    cut = pa.schema(
        [
            ("key", pa.int64()),
            ("n_windows", pa.int32()),
            ("piece", pa.binary()),
            ("members", pa.list_(member)),
        ]
    )

    def cut_pieces(batches):
        """The text under each anchor, or under each window of crowded ones."""
        for doc_ids, text_keys, texts, lists in slices(batches, 2048):
            merged = defaultdict(list)
            for doc_id, text_key, text, found in zip(doc_ids, text_keys, texts, lists, strict=True):
                if not found:
                    continue
                tokens = text.split()
                for anchor in found:
                    first, n_windows = anchor["at"] >> 8, (anchor["at"] & 0xFF) + 1
                    wide = [(first, n_windows)]
                    if anchor["hot"]:
                        wide = [(first + number, 1) for number in range(n_windows)]
                    for start, number in wide:
                        piece = b" ".join(tokens[start : start + number + window - 1])
                        merged[anchor["key"], number, piece].append(
                            {"doc_id": doc_id, "text_key": text_key, "first": start}
                        )
            held = list(merged.items())
            for part in range(0, len(held), 20_000):
                chosen = held[part : part + 20_000]
                yield batch(
                    cut,
                    [k[0] for k, _ in chosen],
                    [k[1] for k, _ in chosen],
                    [k[2] for k, _ in chosen],
                    [members for _, members in chosen],
                )

    members = f"array<struct<doc_id: {id_type}, text_key: bigint, first: bigint>>"
    schema = f"key long, n_windows int, piece binary, members {members}"

    def pieces(hot: bool) -> DataFrame:
        mine = kept.select(
            "doc_id",
            "text_key",
            F.filter("anchors", lambda anchor: anchor["hot"] == F.lit(hot)).alias("anchors"),
        )
        if hot:
            mine = mine.where(F.size("anchors") > 0)
        joined = rows.join(mine, same_row(rows, mine), "left").select(
            rows["doc_id"], rows["text_key"], rows["text"], mine["anchors"]
        )
        return joined.mapInArrow(cut_pieces, schema)

    in_groups = pieces(False).repartition("key").sortWithinPartitions("key")
    # All words of a crowded anchor's windows are prefix: equal windows are counted, with a
    # partial count per task, and the copies of one window may go to many tasks.
    whole = pieces(True).select("piece", "members")
    again = whole.groupBy("piece").agg(F.sum(F.size("members")).alias("n")).where("n > 1")
    whole_spans = (
        join_counted(whole, again, "piece")
        .select(F.explode("members").alias("member"))
        .select(
            "member.doc_id",
            "member.text_key",
            F.col("member.first").alias("start"),
            (F.col("member.first") + window).alias("end"),
        )
    )

    spans = pa.schema(
        [
            ("doc_id", id_field),
            ("text_key", pa.int64()),
            ("start", pa.int64()),
            ("end", pa.int64()),
        ]
    )

    def deep_nodes(batches):
        out: list[tuple] = []
        for _, rows_ in grouped(batches):
            merged = defaultdict(list)
            for _, n_windows, piece, members_ in rows_:
                merged[n_windows, piece].append(members_)
            held = list(merged.items())
            found = repeated_starts(
                [(n, piece, sum(map(len, lists))) for (n, piece), lists in held], window
            )
            for numbers, (_, lists) in zip(found, held, strict=True):
                for start, end in _ranges(numbers, window):
                    out += [
                        (m["doc_id"], m["text_key"], m["first"] + start, m["first"] + end)
                        for members_ in lists
                        for m in members_
                    ]
            if len(out) > 50_000:
                yield batch(spans, *zip(*out, strict=True))
                out = []
        if out:
            yield batch(spans, *zip(*out, strict=True))

    tree_spans = in_groups.mapInArrow(
        deep_nodes, f"doc_id {id_type}, text_key long, start long, end long"
    )
    return tree_spans.unionByName(whole_spans)


def without_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: every document without the words that a
    repeated window covers, the words kept joined by one space."""
    rows = keyed(df, doc_id, text)
    spans = repeated_spans(rows, window)
    covered = spans.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")
    )
    joined = rows.join(covered, same_row(rows, covered), "left").select(
        rows["doc_id"], rows["text_key"], rows["text"], covered["spans"]
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in batches:
            schema = pa.schema(
                [
                    ("doc_id", part.schema.field(0).type),
                    ("n_words", pa.int64()),
                    ("n_removed", pa.int64()),
                    ("kept", pa.binary()),
                ]
            )
            for doc_ids, _, texts, lists in slices([part]):
                sizes, removed, kept = [], [], []
                for text_, found in zip(texts, lists, strict=True):
                    tokens = text_.split()
                    left = tokens
                    if found:
                        gone = np.zeros(len(tokens), bool)
                        for span in found:
                            gone[span["start"] : span["end"]] = True
                        left = [tokens[at] for at in np.flatnonzero(~gone)]
                    sizes.append(len(tokens))
                    removed.append(len(tokens) - len(left))
                    kept.append(b" ".join(left))
                yield batch(schema, doc_ids, sizes, removed, kept)

    schema = f"doc_id {id_type}, n_words long, n_removed long, kept binary"
    return joined.mapInArrow(run, schema).withColumn("kept", F.col("kept").cast("string"))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
