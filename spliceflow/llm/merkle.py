"""Merkle manifest of a dataset, with stored checkpoints and recomputed interior nodes.

Rows are leaves, in order, of one tree per group; the groups' roots, in order, are the leaves of the tree over groups. Runs of ARITY
nodes become their parent. Only every KEPT-th level is stored, as blocks: the nodes of one level below one node KEPT levels
higher (at most ARITY ** KEPT of them). Proofs are read from the top down: each block makes the levels between anew, adds the siblings
that its nodes have there to those of the block's own root, and drops the levels again.

Rows are numbered within their group from a sort by range, so that a group of any share of the rows is spread over tasks; what
continues from one range to the next is one number a range. No step sees more of a group than a range or a block.

Defined cases: a null group is a group of its own, before all others; null keys come first; rows of one key are ordered by their leaf, and
equal rows are leaves of their own. Empty tables give no rows. Groups may have one row. Extra columns are ignored, but those to
carry; all names inside are private.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, stored

ARITY, KEPT = 3, 4
#: Nodes of a whole block.
BLOCK = ARITY**KEPT


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of values, each `-` if null, else its byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


@dataclass
class Tree:
    """Stored levels of the trees of all groups, leaves first: (g, b, nodes array<struct<h, carried>>) with block numbers b per group."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(g, h): the root of each group."""
        top = _grown(self.levels[-1])
        return top.select("g", F.get(f"__l{KEPT}", F.lit(0)).alias("h"))

    def drop(self) -> None:
        for t in self.levels:
            drop_stored(t)


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (g, keys, ...) with i: their place in their group by the keys, from 0."""
    spark, rows = rows.sparkSession, stored(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 1_000_000))
    dealt = rows.repartitionByRange(parts, "g", *keys).sortWithinPartitions("g", *keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, begin, seen, head = TaskContext.get().partitionId(), None, 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            g = batch.column("g")
            g = pa.concat_arrays([g.slice(0, 1) if last is None else last, g])
            a, b = g.slice(0, n), g.slice(1)
            new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
            at = np.arange(seen, seen + n)
            start = np.maximum.accumulate(np.where(new, at, begin))
            heads = np.full(n, head) & ~np.logical_or.accumulate(new)
            last, begin, seen, head = b.slice(n - 1), int(start[-1]), seen + n, bool(heads[-1])
            extra = [pa.array(np.full(n, pid, dtype=np.int32)), pa.array(heads), pa.array((at - start).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "__pid", "__head", "__at"])

    fields = [T.StructField("__pid", T.IntegerType()), T.StructField("__head", T.BooleanType()), T.StructField("__at", T.LongType())]
    placed = stored(dealt.mapInArrow(number, T.StructType([*rows.schema.fields, *fields])))
    drop_stored(rows)
    # a group goes on from one range to the next in at most one run a range, the first: one row a range at most
    earlier = Window.partitionBy("g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__pid", "g").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(earlier))
    before = sizes.where("__before > 0").select("__pid", F.lit(True).alias("__head"), "__before")
    out = placed.join(F.broadcast(before), ["__pid", "__head"], "left")
    return out.withColumn("i", F.col("__at") + F.coalesce("__before", F.lit(0))).drop("__pid", "__head", "__at", "__before")


def _blocks(nodes: DataFrame, carried: list[str] = []) -> DataFrame:
    """(g, b, nodes) of rows (g, i, h, carried)."""
    node = F.struct("i", "h", *carried)
    got = nodes.groupBy("g", F.expr(f"i div {BLOCK}").alias("b")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return got.withColumn("nodes", F.transform("nodes", lambda x: F.struct(x["h"].alias("h"), *(x[c].alias(c) for c in carried))))


def _ends(level: Column) -> Column:
    """Whether a tree ends at this level of its only block (a whole block ends at its last level in any case)."""
    return (F.col("b") == 0) & (F.col("__size") < BLOCK) & (F.size(level) == 1)


def _grown(blocks: DataFrame) -> DataFrame:
    """blocks with the levels __l0 to __l<KEPT> above their nodes."""
    d = blocks.withColumns({"__size": F.size("nodes"), "__l0": F.transform("nodes", lambda x: x["h"])})
    for k in range(KEPT):
        low = F.col(f"__l{k}")
        runs = F.sequence(F.lit(0), F.expr(f"(size(__l{k}) + {ARITY - 1}) div {ARITY} - 1").cast("int"))
        up = F.transform(runs, lambda q: digest(F.array_join(F.slice(low, q * ARITY + 1, ARITY), "")))
        d = d.withColumn(f"__l{k + 1}", F.when(_ends(low), low).otherwise(up))
    return d


def build(leaves: DataFrame, keys: list[str], carried: list[str] = []) -> Tree:
    """Trees of rows (g, h, keys, carried) in the order of the keys, ties by h."""
    placed = _numbered(leaves, [*keys, "h"])
    levels = [stored(_blocks(placed, carried))]
    drop_stored(placed)
    while (levels[-1].agg(F.max("b")).first()[0] or 0) > 0:
        up = _grown(levels[-1]).select("g", F.col("b").alias("i"), F.get(f"__l{KEPT}", F.lit(0)).alias("h"))
        levels.append(stored(_blocks(up)))
    return Tree(levels)


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(g, i, h, carried, columns of above): every node of the blocks with the siblings on its way to the root of its block, followed by those
    of above (g, i: the block's number, path)."""
    def step(k: int, p: Column) -> Column:
        level, q = F.col(f"__l{k}"), F.floor(p / ARITY**k).cast("int")
        within = q % ARITY
        left = F.array_join(F.slice(level, q - within + 1, within), "")
        right = F.array_join(F.slice(level, q + 2, F.lit(ARITY - 1) - within), "")
        return F.when(~_ends(level), F.struct(left.alias("left"), right.alias("right")))

    d = _grown(blocks).alias("x").join(above.withColumnRenamed("i", "b").alias("y"), F.expr("x.g <=> y.g and x.b = y.b"))
    kept = [c for c in above.columns if c not in ("g", "i", "path")]
    d = d.select("x.*", F.col("path").alias("__above"), *kept)
    with_path = F.transform("nodes", lambda x, p: F.struct(x.alias("node"), p.alias("p"), F.filter(F.array(*(step(k, p) for k in range(KEPT))), lambda s: s.isNotNull()).alias("path")))
    d = d.select("g", "b", "__above", *kept, F.explode(with_path).alias("__n"))
    return d.select("g", (F.col("b") * BLOCK + F.col("__n.p")).alias("i"), "__n.node.*", *kept, F.concat("__n.path", "__above").alias("path"))


def _descend(tree: Tree, above: DataFrame) -> DataFrame:
    """Nodes of the lowest level with their paths; above: what follows the groups' roots. Passes through stored tables but for the last."""
    made = above
    for level in reversed(tree.levels[1:]):
        last, made = made, stored(_paths(level, made))
        drop_stored(last)
        drop_stored(level)
        made = made.drop("h")
    return _paths(tree.levels[0], made).drop("i")


def proofs(leaves: DataFrame, keys: list[str], carried: list[str] = []) -> DataFrame:
    """(g, h, carried, subroot, root, path) of rows (g, h, keys, carried): each leaf with its group's root, the root of all, and the steps
    between: array of (left, right), the joined digests of the siblings before and after, level by level."""
    none = F.expr("cast(array() as array<struct<left:string,right:string>>)")
    tree = build(leaves, keys, carried)
    roots = stored(tree.roots())
    groups = build(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), ["name"], ["name"])
    top = groups.roots().select("g", F.lit(0).cast("long").alias("i"), F.col("h").alias("root"), none.alias("path"))
    above = stored(_descend(groups, top).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("i"), F.col("h").alias("subroot"), "root", "path"))
    groups.drop()
    drop_stored(roots)
    return _descend(tree, above)


def fold(start: Column, path: Column | str) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(path: Column | str) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
