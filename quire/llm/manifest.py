"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

A row's leaf is the digest of its fields. The leaves of a group, in their order, are joined in runs of eight into their
digest, level by level, up to the group's subroot; the subroots in the order of their groups are leaves of one more tree
like these, up to the root. Each level is one grouping of at most eight rows a group.

Proofs: every node starts with the segment of siblings around it and a pointer to its parent. In each round a self-join
appends the segments of the node pointed at and takes over its pointer, which doubles the distance; so a tree of depth d
takes log2(d) rounds. Many leaves point at one ancestor then, so an ancestor is copied once for every SHARE leaves below
it, and its leaves are dealt over the copies.

Positions come from a sort into ranges, whose sizes (one number for each range) are added up; no group is ordered in one
task. Rows are ordered by group, then `order`, nulls first, ties by leaf; repeated rows each have a leaf and a proof. A
null field counts as `-`. An empty table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle

#: Nodes in a run.
FAN = 8
#: Leaves below a copy of an ancestor.
SHARE = 256
#: Rows of a block in which groups are met with their sizes.
BLOCK = 512

_PROOF = "array<struct<left:binary,right:binary>>"


def leaf_of(*fields: Column) -> Column:
    """Digest of the values as text, each as its UTF-8 byte count, `:` and itself, or `-` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof make."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def siblings(proof: Column) -> Column:
    """The digests of all siblings as text, level by level."""
    return F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df and `place`: each row's place, from 0, in the order of the columns."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = settle(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    # One row for each range, however many rows df has.
    sizes = sorted(tuple(r) for r in dealt.groupBy("_range").agg(F.count("*"), F.min("_at")).collect())
    start, before = {}, 0
    for number, size, first in sizes:
        start[number] = before - first
        before += size
    starts = df.sparkSession.createDataFrame(list(start.items()), "_range int, _start long")
    return dealt.join(F.broadcast(starts), "_range").withColumn("place", F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")


def _depth(n: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // FAN), depth + 1
    return depth


def _climb(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, pos, n, id, digest, size, leaf) of one level of trees with n nodes in it: the nodes below the tops
    with their pointers and segments, and the tops."""
    below, tops = [], nodes.filter("n = 1")
    for level in range(1, depth + 1):
        kid = F.struct("pos", "id", "digest", "size", "leaf")
        runs = nodes.filter("n > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("up")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
        runs = settle(runs.select("tree", "up", "n", "kids", F.struct("tree", F.lit(level).alias("level"), F.col("up").alias("pos")).alias("to")))
        size = F.aggregate("kids", F.lit(0).cast("long"), lambda a, k: a + k["size"])
        digests = lambda kids: F.unhex(F.array_join(F.transform(kids, lambda k: k["digest"]), ""))
        around = lambda k, i: F.struct(digests(F.slice("kids", 1, i)).alias("left"), digests(F.slice("kids", i + 2, FAN)).alias("right"))
        kids = F.transform("kids", lambda k, i: F.struct(k["id"].alias("id"), k["digest"].alias("digest"), k["size"].alias("size"), k["leaf"].alias("leaf"), F.array(around(k, i)).alias("proof")))
        below.append(runs.select(F.col("to").alias("up"), size.alias("up_size"), F.explode(kids).alias("k")).select("k.*", "up", "up_size"))
        digest = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
        nothing = F.lit(None).cast(nodes.schema["leaf"].dataType).alias("leaf")
        nodes = runs.select("tree", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), F.col("to").alias("id"), digest.alias("digest"), size.alias("size"), nothing)
        tops = tops.unionByName(nodes.filter("n = 1"))
    return below, tops


def manifest(documents: DataFrame, fields: list[str], group: str, order: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the columns of `keep` (by default those of `order`), leaf, subroot, root and proof, an
    array of (left, right): the digests before and after in each run from the leaf to the root."""
    spark = documents.sparkSession
    kept = keep or {c: F.col(c) for c in order}
    leaf = leaf_of(*(F.col(f) for f in fields))
    sort = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    read = documents.select(F.col(group).alias("group"), *sort, F.struct(leaf.alias("leaf"), F.struct(*(x.alias(c) for c, x in kept.items())).alias("kept")).alias("leaf"))
    # The number of the row parts equal rows, so that a range can end between them.
    rows = settle(read.withColumn("digest", F.col("leaf.leaf")).withColumn("_row", F.monotonically_increasing_id()))
    rows = _numbered(rows, ["group", *(f"o{i}" for i in range(len(order))), "digest", "_row"])

    found = rows.groupBy("group").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    trees = _numbered(found, ["group"]).withColumnRenamed("place", "tree")
    most, groups = trees.agg(F.max("n"), F.count("*")).first()
    # A group meets its rows block by block: as many rows as it has blocks.
    blocks = F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + n - 1) div {BLOCK}"))
    known = trees.select(F.col("group").alias("g"), "start", "n", "tree", F.explode(blocks).alias("block"))
    at = rows.withColumn("at", F.expr(f"place div {BLOCK}"))
    met = at.join(known, (F.col("at") == F.col("block")) & F.col("group").eqNullSafe(F.col("g")))
    pos = F.col("place") - F.col("start")
    level = lambda n: F.lit(n).alias("level")
    leaves = met.select("tree", pos.alias("pos"), "n", F.struct("tree", level(0), pos.alias("pos")).alias("id"), "digest", F.lit(1).cast("long").alias("size"), "leaf")

    below, subroots = _climb(leaves, _depth(most or 0))
    tops = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(groups).cast("long").alias("n"), "id", "digest", "size", "leaf")
    above, root = _climb(settle(tops), _depth(groups))
    root = settle(root)
    first = root.select("digest").first()
    no = F.lit(None).cast("string")
    nodes = root.select("id", "digest", "size", "leaf", F.array().cast(_PROOF).alias("proof"), F.lit(None).cast(root.schema["id"].dataType).alias("up"), F.lit(None).cast("long").alias("up_size"), no.alias("subroot"))
    for x in below + above:
        nodes = nodes.unionByName(x.withColumn("subroot", F.col("digest") if above and x is above[0] else no))
    nodes = nodes.drop("digest")

    distance, reach, settled = 1, _depth(most or 0) + _depth(groups), None
    while distance < reach:
        if distance > 1:
            nodes, done = settle(nodes), settled
            if done is not None:
                drop_settled(done)
            settled = nodes
        nodes, distance = _doubled(nodes), 2 * distance
    top = F.lit(first[0] if first else None).cast("string")
    # The only group's subroot is the root, which points at nothing.
    return nodes.filter("leaf is not null").select("leaf.kept.*", F.col("leaf.leaf").alias("leaf"), F.coalesce("subroot", top).alias("subroot"), top.alias("root"), "proof")


def _doubled(nodes: DataFrame) -> DataFrame:
    """Nodes that point twice as far, with the segments on the way."""
    copies = lambda size: F.greatest(F.lit(1), F.ceil(F.col(size) / SHARE)).cast("int")
    copy = F.explode(F.sequence(F.lit(0), copies("size") - 1)).alias("copy")
    far = nodes.filter("leaf is null").select(F.col("id").alias("up"), F.col("proof").alias("more"), F.col("up").alias("beyond"), F.col("up_size").alias("beyond_size"), F.col("subroot").alias("above"), copy)
    moving = nodes.filter("up is not null").withColumn("copy", F.pmod(F.xxhash64("id"), copies("up_size")).cast("int"))
    moved = moving.join(far, ["up", "copy"]).select(
        "id", "size", "leaf", F.concat("proof", "more").alias("proof"), F.col("beyond").alias("up"), F.col("beyond_size").alias("up_size"), F.coalesce("subroot", "above").alias("subroot")
    )
    return moved.unionByName(nodes.filter("up is null").select(*moved.columns))
