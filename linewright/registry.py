"""The operators as queries over the test tables, and the same results in plain SQL."""

from __future__ import annotations

import gzip
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import linewright as lw
from linewright.plans.durable import fresh_dir
from linewright.sources.listing import handle, roots

# Fixed values of the queries below, repeated in their SQL.
LICENCE = "License"
MARKER = "GNU"
HEADER = ("# This group had no GNU notice.", "# Its texts were replaced.")
COLOURS = (("error", "red"), ("click", "green"), ("signup", "yellow"), ("view", "blue"))
PART = 100  # documents that are written as one file
CHUNK = 1 << 16
MEMBER = 1 << 13
RANGE = 1 << 15
REPLIES = ("y", "yes please", " YES ", "n", "", "yEs", "y\n", "Y")


# Queries ending in _by_shuffle leave out the size check, and with it the broadcast: they
# take the way that tables too big to broadcast take. Those ending in _by_sketch broadcast a
# Bloom sketch of the keys, as for keys too many to be broadcast themselves.
BY_SHUFFLE = {"max_broadcast_bytes": 0}
BY_SKETCH = {"max_broadcast_bytes": 1}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "read_lines")
    documents = _table(spark, sf_dir, "documents").select("source", "text")
    documents.write.partitionBy("source").text(folder, lineSep="\n")
    source = F.regexp_extract("file", "^source=([^/]+)/", 1).alias("source")
    line = F.md5("value").alias("line_md5")
    lines = lw.read_lines(spark, folder).select(source, line)
    return lines.groupBy("source", "line_md5").agg(F.count(F.lit(1)).alias("n"))


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files and read back whole, their lines in order."""
    folder = fresh_dir(spark, "read_texts")
    _as_files(_parts(spark, sf_dir), folder)
    texts = lw.neutralise_lines(lw.read_texts(spark, folder), "text", "e")
    return texts.select(_part_of("file"), F.md5("text").alias("text_md5"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(part, text)``: the texts of ``PART`` documents each, in order."""
    documents = _table(spark, sf_dir, "documents")
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    text = F.array_join(F.transform(ordered, lambda row: row["text"]), "\n")
    part = F.expr(f"doc_id div {PART}").alias("part")
    return documents.groupBy(part).agg(text.alias("text"))


def _as_files(parts: DataFrame, folder: str) -> None:
    """Each part as a file below a folder of its number."""
    parts.write.partitionBy("part").text(folder, lineSep="\n")


def _part_of(file: str) -> Column:
    return F.regexp_extract(file, "^part=([0-9]+)/", 1).cast("bigint").alias("part")


def reconcile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files against a checksum list, wrong for every third file."""
    folder, listing = fresh_dir(spark, "files"), fresh_dir(spark, "checksums")
    parts = _parts(spark, sf_dir)
    _as_files(parts, folder)
    names = lw.list_files(spark, folder).select(F.col("file").alias("key"), _part_of("file"))
    body = F.when(F.col("part") % 3 == 0, F.lit("altered")).otherwise(F.col("text"))
    digests = parts.select("part", F.md5(F.concat(body, F.lit("\n"))).alias("md5"))
    entry = F.concat("md5", F.lit("  "), "key", F.lit("\r"))
    lines = names.join(digests, "part").select(entry.alias("value"))
    lines.write.text(listing, lineSep="\n")
    found = lw.reconcile_digests(
        lw.digest_files(spark, folder), lw.read_manifest(spark, listing), "key"
    )
    return found.select(_part_of("key"), "status")


def reconcile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk manifest of documents as files against a copy of them: some files changed in
    places, some longer, some gone, some new."""
    first, copy = fresh_dir(spark, "first"), fresh_dir(spark, "copy")
    parts, n = _parts(spark, sf_dir), F.col("part")
    _as_files(parts.where(n % 7 != 6), first)
    changed = F.when(n % 3 == 0, F.replace("text", F.lit("q"), F.lit("Q"))).otherwise(F.col("text"))
    longer = F.when(n % 4 == 1, F.concat(changed, F.lit("\nnew"))).otherwise(changed)
    _as_files(parts.where(n % 5 != 4).select("part", longer.alias("text")), copy)
    manifest = lw.digest_chunks(spark, first, CHUNK)
    # The two writes name a part's file in their own ways.
    named = lw.list_files(spark, copy).select(_part_of("file"), F.col("file").alias("there"))
    manifest = manifest.withColumn("part", _part_of("key")).join(named, "part", "left")
    key = F.coalesce("there", "key").alias("key")
    manifest = manifest.select(key, "offset", "length", "md5")
    found = lw.reconcile_chunks(spark, copy, manifest)
    return found.select(_part_of("key"), "offset", "length", "status")


def read_member_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gzip files of many members, which cut lines anywhere, read by line."""
    folder = fresh_dir(spark, "members")
    _as_members(_parts(spark, sf_dir), folder)
    index = lw.index_members(spark, folder)
    lines = lw.read_member_lines(index, RANGE)
    part = F.regexp_extract("file", "^([0-9]+)[.]gz$", 1).cast("bigint").alias("part")
    counted = lines.select(part, F.md5("value").alias("line_md5"))
    return counted.groupBy("part", "line_md5").agg(F.count(F.lit(1)).alias("n"))


def _as_members(parts: DataFrame, folder: str) -> None:
    """Each part as a gzip file with a member for every ``MEMBER`` bytes, written by tasks."""
    spark = parts.sparkSession
    shared = folder.rsplit("/", 2)[0]
    root = roots(spark, shared)[0]
    below = f"{root.folder}{folder.removeprefix(shared)}"

    def run(batches):
        system, base = handle(root.store)
        system.create_dir(base + below)
        for batch in batches:
            for part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode() + b"\n"
                pieces = [data[at : at + MEMBER] for at in range(0, len(data), MEMBER)]
                with system.open_output_stream(f"{base}{below}/{part}.gz", None) as out:
                    out.write(b"".join(gzip.compress(piece, 1, mtime=0) for piece in pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["part"])

    parts.select("part", "text").mapInArrow(run, "part long").count()


def count_matching_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return lw.count_matching_lines(documents, "doc_id", "text", LICENCE)


def count_matching_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return lw.count_matching_rows(documents, "source", "text", LICENCE)


def having_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return lw.having_marker(documents, "text", LICENCE).select("doc_id")


def neutralise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = lw.neutralise_lines(documents, "text", LICENCE)
    return changed.select("doc_id", F.md5("text").alias("text_md5"))


def append_if_absent(spark: SparkSession, sf_dir: str, **sizes: Any) -> DataFrame:
    """Every event of every user; customers without events enter by their first order."""
    base = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person"),
        F.lit("event").alias("origin"),
        F.col("event_id").alias("record"),
    )
    incoming = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person"),
        F.lit("order").alias("origin"),
        F.col("o_orderkey").alias("record"),
        "o_orderdate",
    )
    order = ["o_orderdate", "record"]
    return lw.append_if_absent(base, incoming, "person", order, **sizes)


def append_if_absent_by_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_if_absent(spark, sf_dir, **BY_SHUFFLE)


def append_if_absent_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_if_absent(spark, sf_dir, **BY_SKETCH)


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", "event_type", "value"
    )
    latest = lw.latest_per_key(events, "user_id", ["ts", "event_id"])
    return latest.select("user_id", "event_id", "event_type", "value")


def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each length in a language, kept up to date by batches: the newest
    first, one of them twice."""
    folder = fresh_dir(spark, "keep_latest")
    documents = _table(spark, sf_dir, "documents").select("lang", "n_chars", "doc_id", "source")
    for at in (3, 1, 0, 1, 2):
        batch = documents.where(F.col("doc_id") % 4 == at)
        lw.keep_latest(batch, folder, ["lang", "n_chars"], "doc_id", buckets=16)
    return lw.read_latest(spark, folder)


def allocate_free_names(spark: SparkSession, sf_dir: str, **sizes: Any) -> DataFrame:
    """Part names made unique; name and size, with size 1 as none, are taken already."""
    part = _table(spark, sf_dir, "part")
    less_one = F.col("p_size") - 1
    number = F.when(less_one > 0, less_one.cast("string")).otherwise("")
    taken = part.select(F.concat("p_name", number).alias("taken"))
    requests = part.select("p_partkey", "p_name")
    named = lw.allocate_free_names(requests, taken, "p_name", "p_partkey", **sizes)
    return named.select("p_partkey", "name")


def allocate_free_names_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the bases of most requests cut up, whatever the table."""
    per_base = _table(spark, sf_dir, "part").groupBy("p_name").count()
    largest = per_base.agg(F.max("count")).first()[0] or 0
    return allocate_free_names(spark, sf_dir, hot_rows=max(1, largest - 1))


def reserve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each document after its source, from a kept registry, in three runs by thirds
    of the documents in order; every seventh document has a name already."""
    folder = fresh_dir(spark, "reserve_names")
    base = F.concat("source", F.lit("_"))
    documents = _table(spark, sf_dir, "documents").select("doc_id", base.alias("base"), "n_chars")
    number = F.nullif(F.col("n_chars") % 100, F.lit(0)).cast("string")
    taken = F.concat("base", F.coalesce(number, F.lit("")))
    had = documents.where(F.col("doc_id") % 7 == 0)
    lw.found_registry(had.select(taken.alias("taken")), folder, buckets=16)
    requests = documents.where(F.col("doc_id") % 7 != 0).select("doc_id", "base")
    most = requests.agg(F.max("doc_id")).first()[0] or 0
    third = F.expr(f"doc_id * 3 div {most + 1}")
    runs = [
        lw.reserve_names(requests.where(third == at), folder, "base", "doc_id")
        for at in range(3)
    ]
    named = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return named.select("doc_id", "name")


def stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lw.stem_counts(_table(spark, sf_dir, "pages"), "url", "none")


def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_type")
    values = ", ".join(f"('{event_type}', '{colour}')" for event_type, colour in COLOURS)
    colours = spark.sql(f"VALUES {values}").toDF("event_type", "colour")
    coloured = lw.lookup_with_default(events, colours, "event_type", "green")
    return coloured.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))


def lookup_labels(spark: SparkSession, sf_dir: str, **sizes: Any) -> DataFrame:
    """The same operator with a lookup table that grows with the data."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return lw.lookup_with_default(documents, labels, "doc_id", -1, **sizes)


def lookup_labels_by_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_labels(spark, sf_dir, **BY_SHUFFLE)


def lookup_null_values(spark: SparkSession, sf_dir: str, **sizes: Any) -> DataFrame:
    """A lookup table that holds NULL for known keys."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source")
    quality = F.nullif(F.col("quality"), F.lit(0)).alias("quality")
    labels = _table(spark, sf_dir, "labels").select("doc_id", quality)
    return lw.lookup_with_default(documents, labels, "doc_id", -1, **sizes)


def lookup_null_values_by_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_null_values(spark, sf_dir, **BY_SHUFFLE)


def classify_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event gives one of the fixed replies; all but sign-ups may be skipped."""
    replies = F.array(*[F.lit(reply) for reply in REPLIES])
    events = _table(spark, sf_dir, "events").select(
        replies[F.col("event_id") % len(REPLIES)].alias("reply"),
        (F.col("event_type") != "signup").alias("optional"),
    )
    return lw.classify_replies(events, "reply", "optional")


def reconcile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a manifest that has only labelled ones, the poor ones altered,
    and also lists the benchmark items."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    benchmark = _table(spark, sf_dir, "benchmark")
    document_key = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    listed = documents.select(
        "doc_id",
        F.md5("text").alias("right"),
        F.md5(F.concat("text", F.lit("!"))).alias("wrong"),
    ).join(labels, "doc_id")
    manifest = listed.select(
        document_key.alias("key"),
        F.when(F.col("quality") == 1, F.col("right")).otherwise(F.col("wrong")).alias("md5"),
    ).unionByName(
        benchmark.select(
            F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("key"),
            F.md5("text").alias("md5"),
        )
    )
    data = documents.select(document_key.alias("key"), "text")
    return lw.reconcile_digests(data, manifest, "key", content="text")


def missing_inputs(spark: SparkSession, sf_dir: str, **sizes: Any) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels")
    return lw.missing_inputs(documents, labels, "doc_id", **sizes)


def missing_inputs_by_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_inputs(spark, sf_dir, **BY_SHUFFLE)


def missing_inputs_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_inputs(spark, sf_dir, **BY_SKETCH)


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "append_rows")
    customer = _table(spark, sf_dir, "customer")
    supplier = _table(spark, sf_dir, "supplier")
    lw.append_rows(
        customer.select(
            F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
        ),
        folder,
    )
    lw.append_rows(
        supplier.select(
            F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
        ),
        folder,
    )
    return spark.read.parquet(folder)


def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a batch for each tenth of them, and then all again, as by a job run twice."""
    folder = fresh_dir(spark, "append_batches")
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    for at in [*range(10), *range(10)]:
        lw.append_batch(documents.where(F.col("doc_id") % 10 == at), folder, f"tenth-{at}")
    rows = lw.read_batches(spark, folder)
    return rows.select("doc_id", "source", F.md5("text").alias("text_md5"), "batch")


def ensure_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    guarded = lw.ensure_header(documents, "source", "text", MARKER, HEADER)
    return guarded.select("doc_id", "source", F.md5("text").alias("text_md5"))


def ensure_header_by_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a group of its own."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    guarded = lw.ensure_header(
        documents, "doc_id", "text", MARKER, HEADER, **BY_SHUFFLE
    )
    return guarded.select("doc_id", F.md5("text").alias("text_md5"))


def ensure_header_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups too big for one task, on the way that many groups take."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    guarded = lw.ensure_header(
        documents, "source", "text", MARKER, HEADER, hot_rows=20, **BY_SHUFFLE
    )
    return guarded.select("doc_id", "source", F.md5("text").alias("text_md5"))


def replace_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stored table, in place."""
    folder = fresh_dir(spark, "replace_groups")
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lw.append_rows(documents, folder, partition_by=["source"])
    stored = spark.read.schema(documents.schema).parquet(folder)
    headers = lw.header_rows(stored, "source", "text", MARKER, HEADER)
    lw.replace_groups(headers, folder, "source")
    spark.catalog.refreshByPath(folder)
    now = spark.read.schema(documents.schema).parquet(folder)
    return now.select("doc_id", "source", F.md5("text").alias("text_md5"))


def publish_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a table whose readers see all groups replaced or none."""
    folder = fresh_dir(spark, "publish_groups")
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lw.publish_groups(documents, folder, "source")
    stored = lw.read_groups(spark, folder)
    lw.publish_groups(lw.header_rows(stored, "source", "text", MARKER, HEADER), folder, "source")
    now = lw.read_groups(spark, folder)
    return now.select("doc_id", "source", F.md5("text").alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        read_lines,
        read_texts,
        read_member_lines,
        count_matching_lines,
        count_matching_rows,
        having_marker,
        neutralise_lines,
        append_if_absent,
        append_if_absent_by_shuffle,
        append_if_absent_by_sketch,
        latest_per_key,
        keep_latest,
        allocate_free_names,
        allocate_free_names_by_blocks,
        reserve_names,
        stem_counts,
        lookup_with_default,
        lookup_labels,
        lookup_labels_by_shuffle,
        lookup_null_values,
        lookup_null_values_by_shuffle,
        classify_replies,
        reconcile_digests,
        reconcile_files,
        reconcile_chunks,
        missing_inputs,
        missing_inputs_by_shuffle,
        missing_inputs_by_sketch,
        append_rows,
        append_batches,
        ensure_header,
        ensure_header_by_shuffle,
        ensure_header_hot,
        replace_groups,
        publish_groups,
    )
}

ORACLE_SQL: dict[str, str] = {
    "read_lines": """
        WITH lines AS (
            SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents
        )
        SELECT source, md5(line) AS line_md5, count(*)::BIGINT AS n
        FROM lines GROUP BY source, line_md5
    """,
    "read_texts": """
        WITH parts AS (
            SELECT doc_id // 100 AS part, string_agg(text, chr(10) ORDER BY doc_id) AS text
            FROM documents GROUP BY part
        )
        SELECT part, md5(array_to_string(list_transform(
                   string_split(text, chr(10)),
                   lambda line: CASE
                       WHEN left(line, 1) <> '#' AND contains(substr(line, 2), 'e')
                       THEN '#' || line ELSE line END), chr(10)) || chr(10)) AS text_md5
        FROM parts
    """,
    "read_member_lines": """
        WITH lines AS (
            SELECT doc_id // 100 AS part, unnest(string_split(text, chr(10))) AS line
            FROM documents
        )
        SELECT part, md5(line) AS line_md5, count(*)::BIGINT AS n
        FROM lines GROUP BY part, line_md5
    """,
    "count_matching_lines": """
        SELECT doc_id,
               len(list_filter(string_split(text, chr(10)),
                               lambda line: contains(line, 'License')))::BIGINT AS n
        FROM documents
    """,
    "count_matching_rows": """
        WITH lines AS (
            SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents
        )
        SELECT source, count(*) FILTER (WHERE contains(line, 'License'))::BIGINT AS n
        FROM lines GROUP BY source
    """,
    "having_marker": """
        SELECT doc_id FROM documents
        WHERE len(list_filter(string_split(text, chr(10)),
                              lambda line: contains(line, 'License'))) > 0
    """,
    "neutralise_lines": """
        SELECT doc_id, md5(array_to_string(list_transform(
                   string_split(text, chr(10)),
                   lambda line: CASE
                       WHEN left(line, 1) <> '#' AND contains(substr(line, 2), 'License')
                       THEN '#' || line ELSE line END), chr(10))) AS text_md5
        FROM documents
    """,
    "append_if_absent": """
        SELECT user_id AS person, 'event' AS origin, event_id AS record FROM events
        UNION ALL
        SELECT o_custkey, 'order', o_orderkey FROM (
            SELECT *, row_number() OVER (
                PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place
            FROM orders)
        WHERE place = 1 AND o_custkey NOT IN (SELECT user_id FROM events)
    """,
    "latest_per_key": """
        SELECT user_id, event_id, event_type, value FROM (
            SELECT *, row_number() OVER (
                PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
            FROM events)
        WHERE place = 1
    """,
    "allocate_free_names": """
        WITH taken AS (
            SELECT p_name || CASE WHEN p_size > 1 THEN (p_size - 1)::VARCHAR ELSE '' END
                   AS name
            FROM part
        ), sizes AS (
            SELECT p_name, count(*) AS n FROM part GROUP BY p_name
        ), candidates AS (
            SELECT p_name, unnest(range(2 * n)) AS number FROM sizes
        ), free AS (
            SELECT p_name, candidate,
                   row_number() OVER (PARTITION BY p_name ORDER BY number) AS place
            FROM (SELECT p_name, number,
                         p_name || CASE WHEN number > 0 THEN number::VARCHAR ELSE '' END
                         AS candidate
                  FROM candidates)
            WHERE candidate NOT IN (SELECT name FROM taken)
        ), requests AS (
            SELECT p_partkey, p_name,
                   row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS place
            FROM part
        )
        SELECT p_partkey, candidate AS name
        FROM requests JOIN free USING (p_name, place)
    """,
    "stem_counts": """
        WITH names AS (
            SELECT string_split(url, '/')[-1] AS name FROM pages
        )
        SELECT CASE WHEN name IS NULL THEN 'none'
                    WHEN contains(name, '.')
                    THEN left(name, length(name) - strpos(reverse(name), '.'))
                    ELSE name END AS stem,
               count(*)::BIGINT AS n
        FROM names GROUP BY stem
    """,
    "lookup_with_default": """
        SELECT CASE event_type WHEN 'error' THEN 'red' WHEN 'click' THEN 'green'
                    WHEN 'signup' THEN 'yellow' WHEN 'view' THEN 'blue'
                    ELSE 'green' END AS colour,
               count(*)::BIGINT AS n
        FROM events GROUP BY colour
    """,
    "lookup_labels": """
        SELECT doc_id, source, coalesce(quality, -1)::INTEGER AS quality
        FROM documents LEFT JOIN labels USING (doc_id)
    """,
    "lookup_null_values": """
        SELECT d.doc_id, source,
               CASE WHEN l.doc_id IS NULL THEN -1 ELSE nullif(quality, 0) END::INTEGER
               AS quality
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
    "classify_replies": """
        WITH replies AS (
            SELECT ['y', 'yes please', ' YES ', 'n', '', 'yEs', 'y' || chr(10), 'Y']
                       [event_id % 8 + 1] AS reply,
                   event_type <> 'signup' AS optional
            FROM events
        )
        SELECT CASE WHEN lower(trim(reply, ' ' || chr(9))) IN ('y', 'yes') THEN 'proceed'
                    WHEN optional THEN 'skip' ELSE 'abort' END AS outcome,
               count(*)::BIGINT AS n
        FROM replies GROUP BY outcome
    """,
    "reconcile_digests": """
        WITH manifest AS (
            SELECT 'document ' || doc_id AS key,
                   md5(CASE WHEN quality = 1 THEN text ELSE text || '!' END) AS listed
            FROM documents JOIN labels USING (doc_id)
            UNION ALL
            SELECT 'item ' || item_id, md5(text) FROM benchmark
        ), data AS (
            SELECT 'document ' || doc_id AS key, md5(text) AS found FROM documents
        )
        SELECT key, CASE WHEN found IS NULL THEN 'missing'
                         WHEN listed IS NULL THEN 'unlisted'
                         WHEN found = listed THEN 'ok' ELSE 'failed' END AS status
        FROM data FULL JOIN manifest USING (key)
    """,
    "reconcile_files": """
        SELECT DISTINCT doc_id // 100 AS part,
               CASE WHEN doc_id // 100 % 3 = 0 THEN 'failed' ELSE 'ok' END AS status
        FROM documents
    """,
    "reconcile_chunks": """
        WITH parts AS MATERIALIZED (
            SELECT doc_id // 100 AS part, string_agg(text, chr(10) ORDER BY doc_id) AS text
            FROM documents GROUP BY part
        ), bytes AS MATERIALIZED (
            SELECT part,
                   CASE WHEN part % 7 <> 6 THEN hex(encode(text || chr(10))) END AS first,
                   CASE WHEN part % 5 <> 4 THEN hex(encode(
                       CASE WHEN part % 3 = 0 THEN replace(text, 'q', 'Q') ELSE text END
                       || CASE WHEN part % 4 = 1 THEN chr(10) || 'new' ELSE '' END || chr(10)))
                       END AS copy
            FROM parts
        ), chunks AS (
            SELECT *, unnest(range(0, len(first) // 2, 65536)) AS start FROM bytes
        )
        SELECT part, start::BIGINT AS "offset",
               least(65536, len(first) // 2 - start)::BIGINT AS length,
               CASE WHEN copy IS NULL OR len(copy) < least(2 * start + 131072, len(first))
                        THEN 'missing'
                    WHEN substr(copy, 2 * start + 1, least(131072, len(first) - 2 * start))
                         = substr(first, 2 * start + 1, 131072) THEN 'ok'
                    ELSE 'failed' END AS status
        FROM chunks
        UNION ALL
        SELECT part, coalesce(len(first) // 2, 0)::BIGINT,
               (len(copy) // 2 - coalesce(len(first) // 2, 0))::BIGINT, 'unlisted'
        FROM bytes WHERE len(copy) > coalesce(len(first), 0)
    """,
    "missing_inputs": """
        SELECT DISTINCT doc_id FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """,
    "append_rows": """
        SELECT c_name AS name, c_acctbal AS balance FROM customer
        UNION ALL
        SELECT s_name, s_acctbal FROM supplier
    """,
    "append_batches": """
        SELECT doc_id, source, md5(text) AS text_md5, 'tenth-' || (doc_id % 10) AS batch
        FROM documents
    """,
    "keep_latest": """
        SELECT lang, n_chars, doc_id, source FROM (
            SELECT *, row_number() OVER (
                PARTITION BY lang, n_chars ORDER BY doc_id DESC) AS place
            FROM documents)
        WHERE place = 1
    """,
    "reserve_names": """
        WITH named AS (
            SELECT doc_id, source || '_' AS base, n_chars % 100 AS number FROM documents
        ), taken AS (
            SELECT base || CASE WHEN number > 0 THEN number::VARCHAR ELSE '' END AS name
            FROM named WHERE doc_id % 7 = 0
        ), candidates AS (
            SELECT base, unnest(range(count(*) + 100)) AS number FROM named GROUP BY base
        ), free AS (
            SELECT base, candidate, row_number() OVER (PARTITION BY base ORDER BY number) AS place
            FROM (SELECT base, number,
                         base || CASE WHEN number > 0 THEN number::VARCHAR ELSE '' END AS candidate
                  FROM candidates)
            WHERE candidate NOT IN (SELECT name FROM taken)
        ), requests AS (
            SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS place
            FROM named WHERE doc_id % 7 <> 0
        )
        SELECT doc_id, candidate AS name FROM requests JOIN free USING (base, place)
    """,
    "ensure_header": """
        WITH marked AS (
            SELECT source, bool_or(contains(text, 'GNU')) AS has_it
            FROM documents GROUP BY source
        ), header AS (
            SELECT unnest(['# This group had no GNU notice.',
                           '# Its texts were replaced.']) AS line
        )
        SELECT doc_id, source, md5(text) AS text_md5
        FROM documents JOIN marked USING (source) WHERE has_it
        UNION ALL
        SELECT NULL, source, md5(line) FROM marked, header WHERE NOT has_it
    """,
    "ensure_header_by_shuffle": """
        SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE contains(text, 'GNU')
        UNION ALL
        SELECT doc_id, md5(unnest(['# This group had no GNU notice.',
                                   '# Its texts were replaced.']))
        FROM documents WHERE NOT contains(text, 'GNU')
    """,
}
for _name in ("append_if_absent", "lookup_labels", "lookup_null_values", "missing_inputs"):
    ORACLE_SQL[f"{_name}_by_shuffle"] = ORACLE_SQL[_name]
for _name in ("append_if_absent", "missing_inputs"):
    ORACLE_SQL[f"{_name}_by_sketch"] = ORACLE_SQL[_name]
ORACLE_SQL["allocate_free_names_by_blocks"] = ORACLE_SQL["allocate_free_names"]
for _name in ("ensure_header_hot", "replace_groups", "publish_groups"):
    ORACLE_SQL[_name] = ORACLE_SQL["ensure_header"]
