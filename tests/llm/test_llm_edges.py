"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.llm import (
    licenses,
    personal,
    phrases,
    pieces,
    quality,
    repeats,
    shards,
    simhash,
    topk,
    warc,
)
from linewright.llm.common import keyed
from linewright.llm.queries import model_bytes

RANDOM = random.Random(7)
VOCABULARY = [f"w{n}" for n in range(400)]


def prose(n_words):
    return " ".join(RANDOM.choices(VOCABULARY, k=n_words))


COMMON = prose(60)
# Names that the operators use inside.
CLASH = "text_key long, row string, item string, fingerprint long, root long, anchors int, length int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (None, "lonely words here"),
    (None, None),
    (4, COMMON),
    (4, COMMON),
    (5, COMMON + " tail"),
    (6, f"{prose(20)}\n{COMMON}\x0b{prose(20)}"),
    (7, prose(40_000)),
    (8, "Straße ÀÉ ▁▁ x  y z 1.2.3.4 a@b.co +1 (988) 555-2485; 4111 1111 1111 1111 end"),
    (9, "one two"),
    (9, "one two three"),
    (10, "no words: -- ||"),
    (11, "x" * 50_000),
    (12, "was was was was " * 3000),
    (13, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (doc_id, text, None, "s", len(text or ""), at, "r", None, at, at, 0, 1)
        for at, (doc_id, text) in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _sorted(rows):
    return sorted((tuple(row) for row in rows), key=repr)


def test_repeats(docs):
    found = repeats.digests(repeats.without_repeats(docs))
    assert _sorted(found.collect()) == _sorted(brute.repeats(TEXTS))
    assert repeats.without_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("crowded", [1, 3])
def test_crowded_anchors_give_the_same_repeats(spark, docs, crowded):
    rows = repeats.keyed(docs, "doc_id", "text")

    def words(**sizes):
        found = Counter()
        for row in set(repeats.repeated_spans(rows, **sizes).collect()):
            found.update({(row[0], row[1], at): 1 for at in range(row["start"], row["end"])})
        return set(found)

    assert words(crowded=crowded) == words()


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_every_window_has_one_anchor_by_its_content(texts):
    seen = {}
    for tokens in texts:
        tokens = [t.encode() for t in tokens]
        if len(tokens) < 12:
            continue
        covered = []
        for key, first, last in repeats.anchors(tokens, 12):
            covered += range(first, last + 1)
            for at in range(first, last + 1):
                assert seen.setdefault(tuple(tokens[at : at + 12]), key) == key
        assert covered == list(range(len(tokens) - 11))


def test_long_texts_are_anchored_in_stretches(monkeypatch):
    tokens = [w.encode() for w in prose(3000).split()]
    whole = {at: key for key, a, b in repeats.anchors(tokens) for at in range(a, b + 1)}
    monkeypatch.setattr(repeats, "MOST_WORDS", 700)
    parts = {at: key for key, a, b in repeats.anchors(tokens) for at in range(a, b + 1)}
    assert parts == whole


def test_topk(spark):
    rows = [(n, [RANDOM.uniform(-1, 1) for _ in range(8)]) for n in range(600)]
    rows += [(600, None), (601, [None] * 8), (602, [float("nan")] * 8), (603, [float("inf")] * 8)]
    rows += [(700, [])] + [(n, rows[0][1]) for n in range(900, 930)] + [rows[5], rows[100], (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    valid = [
        (n, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
        for n, v in rows
        if n is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    wanted = []
    for n, v in {n: v for n, v in valid if n % 100 == 0}.items():
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), m) for m, w in valid if m != n]
        wanted += [(n, at + 1, m, -s) for at, (s, m) in enumerate(sorted(scores)[:10])]
    is_query = topk.F.col("vec_id") % 100 == 0
    for query_rows, bytes_ in ((2048, 1 << 20), (2, 1 << 20), (2, 0)):
        found = topk.nearest(df, is_query, 10, query_rows=query_rows, max_broadcast_bytes=bytes_)
        assert _sorted(found.collect()) == _sorted(wanted)
    assert topk.nearest(df.limit(0), is_query, 10).collect() == []


def test_topk_of_slices_is_that_of_products():
    random_rows = np.random.default_rng(3)
    for scale in (1, 3, 1000, 10**6, 2**40):
        rows = random_rows.integers(-scale, scale, (300, 5), endpoint=True)
        ids = random_rows.permutation(300) // 2  # each id twice
        block = topk.Block.stored(*topk.Block.of(ids.astype(np.int64), rows).packed())
        for query in random_rows.integers(-min(scale, 10**6), min(scale, 10**6), (20, 5), endpoint=True):
            for own in (-1, 7):
                scores = sorted(
                    (-sum(int(a) * int(b) for a, b in zip(row, query, strict=True)), int(at))
                    for row, at in zip(rows, ids, strict=True)
                    if at != own
                )
                for k in (1, 10, 400):
                    found = block.top(own, query.tolist(), k)
                    assert found == [(-score, at) for score, at in scores[:k]]


def test_the_boundary_of_a_query_is_its_ties():
    """Rows that are looked at one by one are the k best and those equal to the last of them."""
    rows = np.random.default_rng(4).integers(-500, 500, (8192, 64))
    block = topk.Block.of(np.arange(8192), rows)
    for query in rows[:3]:
        sums, _ = block.scores(query.tolist())
        above, even = block.split(sums, 10)
        scores = np.sort(rows @ query)[::-1]
        assert above.bit_count() == (scores > scores[9]).sum()
        assert even.bit_count() == (scores == scores[9]).sum()


def test_quality(spark, docs):
    labels = spark.createDataFrame(
        [(4, 1), (12, 0), (12, 1), (7, 1), (None, 1), (8, None), (99, 0)],
        "doc_id long, quality int",
    )
    found = quality.classified(docs, labels).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in TEXTS)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == brute.held_out(r["doc_id"]) for r in found)
    none = quality.classified(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classified(docs.limit(0), labels).collect() == []


def test_licenses(docs):
    found = licenses.scan(docs).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == {(13, "mit-line"), (13, "cc-by-nc-4.0-line")}
    assert licenses.scan(docs.limit(0)).collect() == []


def test_licenses_with_changed_words(spark):
    notice = licenses.TEMPLATES["mit-notice"].split()
    texts = []
    for n in range(30):
        words = list(notice)
        for _ in range(n % 5):
            words[RANDOM.randrange(len(words))] = "changed"
        texts.append((n, f"{prose(n * 3)} {' '.join(words)} {prose(50)}"))
    found = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    wanted = {(n, name) for n, text in texts for name in brute.licenses(text, licenses.TEMPLATES)}
    assert {(r["doc_id"], r["license"]) for r in found} == wanted and len(wanted) > 5


def test_sharding(spark, docs):
    found = shards.sharded(docs, 4).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in TEXTS)
    assert sorted(r["slot"] for r in found if r["shard"] == 0) == list(
        range(sum(r["shard"] == 0 for r in found))
    )
    assert shards.sharded(docs.limit(0), 4).collect() == []


def test_sharding_by_levels(spark):
    """More groups than one level takes, one of them an eighth of all bytes."""
    most = 4 * (8 * shards.HEAVY + shards.BUNDLES)
    unique = spark.range(3 * most).selectExpr(
        "cast(id as string) item", f"if(id = 0, {3 * most * 20}, 100 + id % 97) as bytes"
    )
    found = shards.assign(unique, 8, most_items=most).join(unique, "item")
    sums = [r[0] for r in found.groupBy("shard").agg(shards.F.sum("bytes").alias("b")).select("b").collect()]
    assert found.count() == 3 * most and len(sums) == 8
    assert max(sums) - min(sums) <= 0.01 * sum(sums) / 8
    with pytest.raises(ValueError, match="most_items"):
        shards.assign(unique, 8, most_items=most - 1)


def test_slots_have_no_gaps_over_blocks(spark):
    rows = [(n, f"text {n % 700}") for n in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slots = shards.sharded(df, 8, block_rows=40).collect()
    for shard in range(8):
        own = sorted(r["slot"] for r in slots if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_differencing_beats_halves_apart():
    assert shards.differencing([], 3) == []
    sizes = [8, 7, 6, 5, 4]
    sums = Counter()
    for size, shard in zip(sizes, shards.differencing(sizes, 2), strict=True):
        sums[shard] += size
    assert sorted(sums.values()) == [14, 16]


@pytest.mark.parametrize("n_shards", [2, 3, 24])
def test_differencing_is_that_of_a_plain_version(n_shards):
    draw = random.Random(n_shards)
    for n in (1, 2, 5, 40):
        sizes = [draw.choice([1, 7, draw.randrange(1, 5000)]) for _ in range(n)]
        sums = [0] * n_shards
        for size, shard in zip(sizes, shards.differencing(sizes, n_shards), strict=True):
            sums[shard] += size
        wanted = brute.differenced(sizes, n_shards)
        assert sum(sums) == sum(wanted)
        assert max(sums) - min(sums) == wanted[-1] - wanted[0]


PIECES = ["a", "9", "1", "@", ".", "+", " ", "-", "(", ")", "b.c", "é", "255.", "4111 1111 1111 1111", "+1 988 555 2485", "x@y.z", "http://u:p@h.io", "IBAN GB82 WEST 1234 5698 7654 32", "account no. 1234567"]


@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    found = personal.spans(text, personal.automaton())
    assert [(k, a, b) for a, b, k in found if k in personal.BASE] == brute.personal(text)


def test_added_spans():
    anchors = personal.automaton()
    text = "see http://u:pw@h.example.io/x, IBAN GB82 WEST 1234 5698 7654 32; Account no. 1234567."
    found = {kind: text[a:b] for a, b, kind in personal.spans(text, anchors)}
    assert found["login"] == "http://u:pw@h.example.io"
    assert found["iban"] == "GB82 WEST 1234 5698 7654 32" and found["account"] == "1234567"
    hidden = personal.redacted(text, personal.spans(text, anchors))
    assert hidden == "see [LOGIN]/x, IBAN [IBAN]; Account no. [ACCOUNT]."


def test_personal_data(docs):
    found = personal.digests(personal.find_personal(docs)).collect()
    wanted = []
    for doc_id, text in TEXTS:
        spans = brute.personal(text)
        counts = Counter(kind for kind, _, _ in spans)
        joined = ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
        wanted.append((doc_id, *[counts[kind] for kind in brute.BASE], brute.hexed(joined), joined))
    assert _sorted(found) == _sorted(wanted)
    assert personal.find_personal(docs.limit(0)).collect() == []


PAGES = "page_id long, url string, html string, key string, digest string"


def test_warc(spark):
    long = "<p>" + "é" * 100
    rows = [
        (5, "http://www.b.org:80/x?q=1#top", long),
        (3, "http://a.b.org/x y", long),
        (9, "http://a.b.org/x y", long),
        (3, "http://other.net/", long),
        (None, None, long),
        (11, "not a url\r\nX: y", "short"),
        (12, "", "short"),
        (13, "http://b.org/ü", None),
        (13, "http://b.org/ü", None),
        (None, "http://z.org/", "y" * 200),
    ]
    df = spark.createDataFrame([(*r, "k", "d") for r in rows], PAGES).repartition(3)
    found = warc.round_trip(df).collect()
    wanted = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        again = html == long and page_id != 3
        wanted.append((page_id, len(body), brute.hexed(html or ""), "revisit" if again else "response", 3 if again else None))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert _sorted([r[c] for c in columns] for r in found) == _sorted(wanted)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_url_keys(spark):
    df = spark.createDataFrame([("HTTPS://User@WWW.b.Org:8080/P?q=1#f",), ("a b#c",), (None,)], "url string")
    found = [r[0] for r in df.select(warc.url_key("url")).collect()]
    assert found == ["org,b,www)/P?q=1", ")a_b", ")"]


def test_index_blocks_and_unknown_keys(spark, tmp_path, monkeypatch):
    rows = [(n, f"http://h{n % 7}.io/{n}", "x" * n) for n in range(2500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    archives, folder = str(tmp_path / "a"), str(tmp_path / "i")
    files = warc.write_index(warc.write_archives(df, archives), folder)
    assert files == sorted(files) and len(files) > 1
    index = warc.CaptureIndex(archives, folder, files)
    for n in (0, 1, 999, 2499):
        (data,) = index.captures(f"io,h{n % 7})/{n} {n}".encode())
        assert warc.parsed(data)[0]["WARC-Record-ID"] == f"<urn:page:{n}>"
    assert list(index.captures(b"io,h1)/none 1")) == list(index.captures(b"")) == []


def test_simhash(docs):
    found = simhash.near_duplicates(docs).collect()
    got = [(r["doc_id"], f"{r['fingerprint'] % (1 << 64):016x}", r["component_id"]) for r in found]
    assert _sorted(got) == _sorted(brute.components(TEXTS))
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["root"] for r in found})


def test_crowded_shards_lose_no_link(spark, monkeypatch):
    centre, values = RANDOM.getrandbits(64), set()
    for _ in range(400):
        value = centre
        for bit in RANDOM.sample(range(64), RANDOM.randrange(6)):
            value ^= 1 << bit
        values.add(value)
    values |= {RANDOM.getrandbits(64) for _ in range(300)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")

    def parts():
        roots = dict(map(tuple, simhash.components(simhash.links(df)).collect()))
        groups = {}
        for value in values:
            groups.setdefault(roots.get(value, value), set()).add(value)
        return sorted(map(sorted, groups.values()))

    wanted = {}
    for a, b in simhash.star_links([v % (1 << 64) for v in values], 2):
        wanted.setdefault(b, {b}).add(a)
    linked = {v for group in wanted.values() for v in group}
    groups = [[v - (1 << 64) if v >> 63 else v for v in sorted(g)] for g in wanted.values()]
    groups += [[v] for v in values if v % (1 << 64) not in linked]
    wanted = sorted(map(sorted, groups))
    assert parts() == wanted
    monkeypatch.setattr(simhash, "CROWDED", 5)
    assert parts() == wanted


def test_components_of_chains(spark):
    edges = [(n, n + 1) for n in range(0, 60)] + [(200, 100), (100, 150), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = dict(map(tuple, simhash.components(df).collect()))
    assert found == {**{n: 0 for n in range(1, 61)}, 150: 100, 200: 100}


ITEMS = [
    (1, COMMON),
    (1, COMMON),
    (2, "one two"),
    (10, "Lonely, WORDS"),
    (3, None),
    (4, "--"),
    (None, "one two three"),
    (5, "straße àé"),
]


def test_decontamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = brute.contamination(TEXTS, ITEMS)
    for most_bytes in (1 << 20, 100, 1):
        found = phrases.digests(phrases.contamination(docs, items, most_bytes=most_bytes))
        assert _sorted(found.collect()) == _sorted(wanted)
    none = phrases.digests(phrases.contamination(docs, items.limit(0))).collect()
    assert len(none) == len(TEXTS) and not any(r["contaminated"] for r in none)
    assert phrases.contamination(docs.limit(0), items).collect() == []
    left = phrases.without_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == sum(not row[-1] for row in wanted)


def test_one_benchmark_text_under_many_ids(spark):
    """A text is searched once, whatever ids have it, null ones included."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    items = [(n, text) for n in range(3000)] + [(None, text + " omicron"), (None, "solo word pair")]
    docs = [(1, f"so {text} end"), (2, "solo word pair"), (3, "none of it")]
    found = phrases.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        most_bytes=40,
    )
    assert _sorted(phrases.digests(found).collect()) == _sorted(brute.contamination(docs, items))
    assert {r["doc_id"]: (len(r["items"]), r["contaminated"]) for r in found.collect()} == {
        1: (3000, True), 2: (0, True), 3: (0, False),
    }


def test_slices_of_the_benchmark_are_bounded(spark):
    texts = [f"word{n} " * RANDOM.randint(1, 30) for n in range(200)]
    items = spark.createDataFrame([(n % 7, t) for n, t in enumerate(texts * 3)], "item long, text string")
    rows = phrases.sliced(items, 500).collect()
    assert sorted(r["text"] for r in rows) == sorted(texts) and len({r["number"] for r in rows}) == 200
    sizes = Counter()
    for row in rows:
        sizes[row["slice"]] += len(row["text"])
    assert max(sizes.values()) <= 500 + max(map(len, texts)) and len(sizes) >= sum(map(len, texts)) // 800


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "big red very old house"), (2, "house old red big")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red old house")], "item_id long, text string")
    assert not any(r["contaminated"] for r in phrases.contamination(docs, items).collect())
    near = {r["doc_id"]: r["items"] for r in phrases.contamination(docs, items, slop=1).collect()}
    assert near == {1: ["1"], 2: []}


def test_sentencepiece(docs):
    found = pieces.digests(pieces.encode(docs, model_bytes())).collect()
    assert _sorted(found) == _sorted(brute.tokens(TEXTS))
    assert pieces.encode(docs.limit(0), model_bytes()).collect() == []


TABLE = pieces.ChunkTable(model_bytes(), most=20_000)


@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n\x00<s>é　"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_chunks_are_what_the_library_gives(text):
    ids, decoded = TABLE.encode(text)
    whole = TABLE.model.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == whole
    assert decoded == TABLE.model.decode(whole)


def test_the_table_of_chunks_is_bounded_by_bytes():
    """Texts without blanks are one chunk each, which nobody meets again."""
    table = pieces.ChunkTable(model_bytes(), most=100_000)
    letters = [chr(0x4E00 + n) for n in range(3000)]
    most = 0
    for n in range(300):
        text = "".join(RANDOM.choices(letters, k=1000)) if n % 2 else " ".join(RANDOM.choices(letters, k=99))
        ids, decoded = table.encode(text)
        whole = table.model.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == whole and decoded == table.model.decode(whole)
        assert all(len(chunk) <= pieces.LONGEST for chunk in table.ids)
        most = max(most, table.held)
    assert most <= 100_000 + 99 * 2 * pieces.ENTRY_BYTES


def test_models_that_change_blanks_are_refused(monkeypatch):
    table = pieces.ChunkTable(model_bytes())
    table.check()

    class Squeezing:
        """A model whose normaliser makes one blank of several."""

        def __getattr__(self, name):
            return getattr(table.model, name)

        def encode(self, text, **options):
            squeeze = lambda one: re.sub(" +", " ", one).strip()
            return table.model.encode(
                squeeze(text) if isinstance(text, str) else list(map(squeeze, text)), **options
            )

    other = pieces.ChunkTable(model_bytes())
    other.model = Squeezing()
    with pytest.raises(ValueError, match="normaliser"):
        other.check()


def test_stages_take_empty_tables(spark, docs, tmp_path):
    for name in ("labels", "benchmark"):
        source = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        source.write.parquet(str(tmp_path / f"{name}.parquet"))
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, rows, str(tmp_path))
            assert kept.columns == docs.columns
            assert kept.count() <= rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()


def test_a_passage_in_most_texts_is_split_among_tasks(spark):
    """Its anchors and, if crowded, its windows are joined by tasks that share a key's rows."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    kept = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        many = spark.range(0, 3000, 1, 8).select(
            F.col("id").alias("doc_id"),
            F.expr(
                "concat(array_join(transform(sequence(1, 50), i -> concat('a', i)), ' '), ' ',"
                "array_join(transform(sequence(1, 50), i -> concat('w', 1000 * id + i)), ' '))"
            ).alias("text"),
        )
        found = repeats.repeated_spans(keyed(many, "doc_id", "text"))
        rows = found.groupBy("doc_id").agg(F.min("start").alias("a"), F.max("end").alias("b"))
        spans = rows.groupBy("a", "b").count()
        assert [tuple(row) for row in spans.collect()] == [(0, 50, 3000)]
        text = spans._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert "SortMergeJoin(skew=true)" in text.split("Initial Plan")[0]


def test_the_stage_goes_by_bits_alone(spark, tmp_path):
    """Copies within two bits go; texts further apart stay, however alike their words."""
    draw = random.Random(8)
    texts = []
    for _ in range(120):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        changed = list(words)
        for at in draw.sample(range(200), 3):
            changed[at] = "changed"
        texts += [" ".join(words), " ".join(changed), " ".join(words).upper()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each(spark, rows, str(tmp_path))
    heads = {row[2] for row in brute.components(list(enumerate(texts)))}
    assert {r["doc_id"] for r in kept.collect()} == heads
    assert 120 < len(heads) <= 240


def _sliding_licenses(text, name, lengths):
    """Whether a window of so many template lengths, slid by one shingle, has 0.8 of it."""

    def cut(value):
        words = re.findall("[a-z0-9]+", value.lower())
        return [tuple(words[at : at + 5]) for at in range(len(words) - 4)]

    own, wanted = cut(text), cut(licenses.TEMPLATES[name])
    span = lengths * len(wanted)
    return any(
        len(set(own[at : at + span]) & set(wanted)) >= 0.8 * len(set(wanted))
        for at in range(max(1, len(own) - span + 1))
    )


def test_broken_licenses_are_found_wherever_they_start(spark):
    texts = []
    for name, inserted in (("gpl-header", 9), ("gpl-header", 18), ("mit-notice", 40)):
        words = licenses.TEMPLATES[name].split()
        middle = len(words) // 2
        broken = [*words[:middle], *[f"own{at}" for at in range(inserted)], *words[middle:]]
        for offset in range(len(words)):
            text = " ".join([*[f"p{at}" for at in range(offset)], *broken, "end " * 50])
            texts.append((len(texts), name, offset, text))
    assert all(_sliding_licenses(text, name, 2) for _, name, _, text in texts)
    rows = spark.createDataFrame([(n, text) for n, _, _, text in texts], "doc_id long, text string")
    found = {(r["doc_id"], r["license"]): r["first_shingle"] for r in licenses.scan(rows).collect()}
    assert found == {(n, name): offset for n, name, offset, _ in texts}
