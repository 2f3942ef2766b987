"""Merkle manifest of a table: leaves, one tree for each source, one tree over the sources' roots.

Levels are DataFrames (grp, idx, n, digest): the idx-th of n nodes of a group. Nodes whose floor(idx / FANOUT) agree are one
parent's children; a parent hashes its sorted children. A group that has one node is done: that is its subroot.
Going up, each level has a third of the rows of the one below. Proofs come down the same way: a parent's path to the
root is joined with the parent once and handed on to its children with their own siblings before it, so all joins of
a tree together move 1.5 times the leaves and not one row for each leaf and level.

Leaves get their numbers by ``numbered``: rows are dealt by ranges of (group, order), so a hot source lies in
many ranges; row_number counts inside a range, and the sizes of the ranges before it are added. No window spans a
source. Each level is stored, so a lost executor costs one level.

Hashes are lowercase hex sha256; digests go into them as hex text. A leaf hashes its row's fields, each as
'-' if null, else its UTF-8 byte count, ':', and its value.

Defined cases: a null source is a group of its own, before all others; rows without a doc_id come first in their group
and are never tampered with; rows that repeat a doc_id stand in the order of their leaves, and equal rows are equal
leaves side by side; empty texts have zero bytes; a group of one row has no siblings from its own tree. An empty table gives no
rows. Columns beyond the named fields are not read. Texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with idx (from 0, in the order given) and n, both inside their group; group may be null."""
    dealt = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 4, group, *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "dealt")
    sizes = dealt.groupBy(group, "part").agg(F.count("*").alias("rows"))
    # a row for each group and range that it has rows in: ranges of one group are no more than there are ranges
    own = Window.partitionBy(group)
    offsets = sizes.withColumn("base", F.sum("rows").over(own.orderBy("part")) - F.col("rows")).withColumn("n", F.sum("rows").over(own))
    inside = dealt.withColumn("at", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)))
    met = inside.alias("x").join(offsets.alias("y"), F.expr(f"x.{group} <=> y.{group} AND x.part = y.part"))
    return met.select("x.*", (F.col("base") + F.col("at") - 1).alias("idx"), "y.n").drop("part", "at")


def tree(leaves: DataFrame, name: str, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Levels above the leaves, as (grp, idx, n, digest, children), and the roots (grp, digest); leaves: grp, idx, n, digest (stored)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, above, roots = leaves.select("grp", "idx", "n", "digest"), [], leaves.where("n = 1").select("grp", "digest")
    while most > 1:
        runs = level.where("n > 1").groupBy("grp", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.first("n").alias("below"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("children"))
        parents = runs.select("grp", "idx", F.ceil(F.col("below") / fanout).alias("n"), F.sha2(F.concat_ws("", "children.digest"), 256).alias("digest"), "children")
        level = stored(parents, name)
        above.append(level)
        roots = roots.unionByName(level.where("n = 1").select("grp", "digest"))
        most = -(-most // fanout)
    return above, roots


def paths(above: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """(grp, idx, path) of the nodes just below ``above``: what stands before and behind, level by level up to the root.

    ends: (grp, path), what follows for each group behind its root. Leaves that are roots themselves are not in the result.
    """
    known = None
    for k, level in reversed(list(enumerate(above))):
        top = level.where("n = 1").join(ends, F.expr("grp <=> end_grp")).select("grp", "idx", "children", "path")
        if known is not None:
            rest = level.where("n > 1").alias("p").join(known.alias("q"), F.expr("p.grp <=> q.grp AND p.idx = q.idx")).select("p.grp", "p.idx", "children", "path")
            top = top.unionByName(rest)
        siblings = F.struct(
            F.concat_ws("", F.slice(F.col("children.digest"), F.lit(1), F.col("at"))).alias("before"),
            F.concat_ws("", F.slice(F.col("children.digest"), F.col("at") + 2, F.size("children"))).alias("after"),
        )
        spread = top.select("grp", "children", "path", F.posexplode("children").alias("at", "child"))
        known = stored(spread.select("grp", F.col("child.idx").alias("idx"), F.concat(F.array(siblings), "path").alias("path")), f"{name}-{k}")
    return known


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    values = [F.col(c) for c in FIELDS]
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    # a second hash only where there is something to delete
    changed = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n"), leaf([*values[:-1], cut]))
    rows = docs.select("doc_id", F.col("source").alias("grp"), leaf(values).alias("digest"), changed.alias("changed"))
    leaves = stored(numbered(rows, "grp", ["doc_id", "digest"]), "leaves")
    above, roots = tree(leaves, "level", fanout)
    subroots = stored(roots, "subroots")
    tops = stored(numbered(subroots.withColumnsRenamed({"grp": "source"}).withColumn("grp", F.lit(0)), "grp", ["source"]), "tops")
    higher, root = tree(tops, "top-level", fanout)
    none = F.expr("CAST(array() AS array<struct<before:string,after:string>>)")
    top_paths = tops.where("n = 1").select(F.col("source").alias("end_grp"), "digest", none.alias("path"))
    if higher:
        up = paths(higher, root.select(F.col("grp").alias("end_grp"), none.alias("path")), "top-path")
        top_paths = tops.join(up, ["grp", "idx"]).select(F.col("source").alias("end_grp"), "digest", "path")
    ends = stored(top_paths.crossJoin(F.broadcast(root.select(F.col("digest").alias("root")))), "ends")  # one root
    found = leaves.where("n = 1").join(ends, F.expr("grp <=> end_grp")).select("grp", "idx", "path")
    if above:
        found = found.unionByName(paths(above, ends.select("end_grp", "path"), "path"))
    whole = leaves.alias("l").join(found.alias("f"), F.expr("l.grp <=> f.grp AND l.idx = f.idx")).join(ends.select("end_grp", F.col("digest").alias("subroot"), "root").alias("e"), F.expr("l.grp <=> e.end_grp"))
    folded = F.aggregate("path", F.coalesce("changed", "l.digest"), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"]))), 256)
    out = whole.select("doc_id", F.col("l.digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
