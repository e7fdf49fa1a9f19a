"""Merkle manifest of a dataset: one tree per source, and one tree over the sources.

A tree grows by slot pivots. Nodes of a level have dense positions, so position ``p`` is slot
``p % fanout`` of parent ``p / fanout``; one aggregation by parent spreads its children into
``fanout`` columns, and the hash of the columns side by side is the parent. A level is a
``fanout``-th of the one before, and no group has more than ``fanout`` rows, whatever the
sources' sizes. The pivoted rows of all levels are kept, and the proofs come down through them:
each row holds a parent's children, so a child's siblings are the columns but its own, and it
inherits the rest of its path from the parent. All is made of Spark's own functions.

Positions come from range pieces that are fixed by a written table, so a lost executor cannot
change them: the rows of a source are counted piece by piece, and a row's position is its
place in its piece plus the rows of the pieces before.

Nulls are hashed as ``-``, apart from empty texts (``0:``). A null source is a source of its
own and comes first; null ids come first in their source. Rows of one id are ordered by their
leaf, so that fully repeated rows are a leaf each. A source with one row has its leaf for
subroot; one source alone has its subroot for root. An empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.plans.durable import durable
from linewright.plans.keys import key_struct
from linewright.plans.sizing import fits_broadcast

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP, ORDER, TEXT = "source", "doc_id", "text"
PIECE_BITS = 33  # of monotonically_increasing_id(), below the partition's number


def encoded(value: Column) -> Column:
    """A value as bytes that no other sequence of values has: its length goes first."""
    written = value.cast("string")
    sized = F.concat(F.octet_length(written).cast("string"), F.lit(":"), written)
    return F.coalesce(sized, F.lit("-"))


def digest(parts: list[Column]) -> Column:
    """The hash of fields side by side, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(fields: dict[str, Column]) -> Column:
    return digest([encoded(value) for value in fields.values()])


def _placed(rows: DataFrame, order: list[str], group: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in the order of ``group`` and ``order``, written as range pieces with a place
    ``__at``; and the runs of a group in a piece, ``(group, __piece, __shift, n)``.

    A run's shift takes a row's place to its position within the group, and n is the number
    of the group's rows. A group has a run per piece at most, even one that holds most rows.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [group, *order]
    sorted_ = rows.repartitionByRange(tasks, *sort).sortWithinPartitions(*sort)
    placed = sorted_.withColumn("__at", F.monotonically_increasing_id())
    placed = durable(placed.withColumn("__piece", F.shiftright("__at", PIECE_BITS)))
    runs = placed.groupBy(group, "__piece").agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    of_group = Window.partitionBy(group)
    before = F.sum("__rows").over(
        of_group.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = F.coalesce(before, F.lit(0)) - F.col("__first")
    n = F.sum("__rows").over(of_group)
    return placed, durable(runs.select(group, "__piece", shift.alias("__shift"), n.alias("n")))


def _positioned(placed: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """The rows with their position ``pos`` in the group and what else ``runs`` says of it."""
    named = runs.withColumn("__run", key_struct(["__piece", group])).drop("__piece", group)
    named = F.broadcast(named) if fits_broadcast(named) else named.hint("merge")
    met = placed.join(named, key_struct(["__piece", group]) == F.col("__run"))
    found = met.withColumn("pos", F.col("__at") + F.col("__shift"))
    return found.drop("__at", "__piece", "__run", "__shift")


@dataclass(frozen=True)
class Forest:
    """Trees, each named by ``tree``. ``levels[k]`` holds the parents of level k's nodes:
    ``(tree, pos, n, node, slots)``, n the number of nodes on the parents' level and slots
    their children, ``(node, ...)`` each. ``tops`` is ``(tree, height, node)``."""

    levels: list[DataFrame]
    tops: DataFrame


def _pivoted(nodes: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """Parents ``(tree, pos, n, node, s0, s1, ...)`` of ``(tree, pos, n, node, *carried)``."""
    slot = F.col("pos") % fanout
    child = F.struct("node", *carried)
    named = [f"s{at}" for at in range(fanout)]
    # Dealt out first: to sort rows by parent before that would bring nothing together.
    dealt = nodes.withColumn("parent", F.expr(f"pos div {fanout}")).repartition("tree", "parent")
    spread = dealt.groupBy("tree", "parent").agg(
        F.max("n").alias("below"),
        *[F.max(F.when(slot == at, child)).alias(name) for at, name in enumerate(named)],
    )
    # A slot that the last run lacks adds nothing.
    side_by_side = [
        F.coalesce(hexed(F.col(f"{name}.node")), F.lit("")) for name in named
    ]
    return spread.select(
        "tree",
        F.col("parent").alias("pos"),
        F.ceil(F.col("below") / fanout).alias("n"),
        digest(side_by_side).alias("node"),
        *named,
    )


def grown(
    leaves: DataFrame, most: int, fanout: int = FANOUT, carried: tuple[str, ...] = ()
) -> Forest:
    """The trees over ``(tree, pos, n, node, *carried)``, n the number of the tree's leaves and
    ``most`` the largest of these."""
    level = leaves
    levels: list[DataFrame] = []
    tops = [level.where("n = 1").select("tree", F.lit(0).alias("height"), "node")]
    while most > 1:
        level = durable(_pivoted(level.where("n > 1"), fanout, list(carried) if not levels else []))
        levels.append(level)
        tops.append(level.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), "node"))
        most = -(-most // fanout)
    every = tops[0]
    for top in tops[1:]:
        every = every.unionByName(top)
    return Forest(levels, every)


def proven(forest: Forest, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(tree, top, path, child)`` of every leaf whose tree has other nodes.

    ``above`` is ``(tree, height, top, path)`` per tree, the path from its top node on. A path
    is a list of ``(left, right)``, what stands on either side of the node at each level, from
    the leaf upwards; ``child`` is the leaf with the columns that ``grown`` carried.
    """
    named = [f"s{at}" for at in range(fanout)]
    inherited = None
    for height in range(len(forest.levels), 0, -1):
        tops = above.where(F.col("height") == height).select(
            "tree", F.lit(0).cast("long").alias("pos"), "top", "path"
        )
        inherited = tops if inherited is None else inherited.unionByName(tops)
        parents = forest.levels[height - 1].select("tree", "pos", *named)
        met = parents.join(inherited, ["tree", "pos"])

        def part(names: list[str]) -> Column:
            empty = F.lit(b"")
            return F.concat(empty, *[F.coalesce(F.col(f"{name}.node"), empty) for name in names])

        children = F.array(
            *[
                F.struct(
                    F.lit(at).alias("slot"),
                    F.col(name).alias("child"),
                    F.struct(part(named[:at]).alias("left"), part(named[at + 1 :]).alias("right")).alias(
                        "beside"
                    ),
                )
                for at, name in enumerate(named)
            ]
        )
        spread = met.select("tree", "pos", "top", "path", F.explode(children).alias("c"))
        inherited = spread.where("c.child.node is not null").select(
            "tree",
            (F.col("pos") * fanout + F.col("c.slot")).alias("pos"),
            "top",
            F.concat(F.array("c.beside"), "path").alias("path"),
            *([F.col("c.child").alias("child")] if height == 1 else []),
        )
    return inherited


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf has with such siblings, as bytes."""
    last = F.aggregate(
        path,
        hexed(node),
        lambda acc, beside: F.sha2(
            F.concat(hexed(beside["left"]), acc, hexed(beside["right"])).cast("binary"), 256
        ),
    )
    return F.unhex(last)


def path_digest(path: Column) -> Column:
    """The hash of all siblings' digests, from the leaf's own level up, left to right."""
    beside = F.transform(path, lambda b: hexed(F.concat(b["left"], b["right"])))
    return F.sha2(F.array_join(beside, "").cast("binary"), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Where 2 divides the id's checksum, the text without its newlines."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def manifest(
    df: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = GROUP,
    order: str = ORDER,
    fanout: int = FANOUT,
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """``(order, leaf, subroot, root, path, other)`` per row of ``df``; digests are bytes.

    Leaves are hashes of ``fields``, and ``other`` is the leaf with ``changed`` in place of some
    of them: what a copy to be verified against the proof would have there.
    """
    if fanout < 2:
        raise ValueError("a parent needs room for two children")
    own = {name: F.col(f"`{name}`") for name in fields}
    leaves = durable(
        df.select(
            F.col(f"`{order}`").alias("key"),
            F.col(f"`{group}`").alias("group"),
            leaf(own).alias("node"),
            leaf(own | (changed or {})).alias("other"),
            # Parts equal rows, so that no piece has to hold very many of them.
            F.monotonically_increasing_id().alias("copy"),
        )
    )
    placed, runs = _placed(leaves, ["key", "node", "copy"], "group")
    groups, spans = _placed(
        runs.select("group").distinct().withColumn("all", F.lit(0)), ["group"], "all"
    )
    trees = durable(_positioned(groups, spans, "all").select("group", F.col("pos").alias("tree")))
    numbers = trees.select(key_struct("group").alias("__group"), "tree")
    numbered = runs.join(numbers, key_struct("group") == F.col("__group")).drop("__group")
    rows = _positioned(placed, durable(numbered), "group")
    most = runs.agg(F.max("n")).first()[0] or 0
    forest = grown(rows, most, fanout, ("key", "other"))

    n_trees = trees.count()
    subroots = forest.tops.select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("pos"),
        F.lit(n_trees).cast("long").alias("n"),
        "node",
        "height",
    )
    crown = grown(subroots, n_trees, fanout, ("height",))
    beside = "array<struct<left:binary,right:binary>>"
    roots = crown.tops.select(
        "tree",
        "height",
        F.struct("node").alias("top"),
        F.array().cast(beside).alias("path"),
    )
    lone = subroots.where("n = 1").select(
        F.col("pos").alias("tree"),
        "height",
        F.struct(F.col("node").alias("subroot"), F.col("node").alias("root")).alias("top"),
        F.array().cast(beside).alias("path"),
    )
    above = lone
    if crown.levels:
        found = proven(crown, roots, fanout)
        above = found.select(
            F.col("pos").alias("tree"),
            F.col("child.height").alias("height"),
            F.struct(F.col("child.node").alias("subroot"), F.col("top.node").alias("root")).alias("top"),
            "path",
        )
    above = durable(above)
    alone = rows.where("n = 1").select("tree", "key", "node", "other")
    rest = alone.join(above, "tree").select("key", "node", "other", "top", "path")
    if forest.levels:
        below = proven(forest, above, fanout).select("child.key", "child.node", "child.other", "top", "path")
        rest = below.unionByName(rest)
    return rest.select(
        F.col("key").alias(order),
        F.col("node").alias("leaf"),
        F.col("top.subroot").alias("subroot"),
        F.col("top.root").alias("root"),
        "path",
        "other",
    )


def digests(found: DataFrame, order: str = ORDER) -> DataFrame:
    """Each row's proof by its hash, and whether the other leaf folds to the root."""
    again = folded(F.col("other"), F.col("path"))
    return found.select(
        F.col(order),
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        path_digest(F.col("path")).alias("proof_sha256"),
        hexed(again).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
