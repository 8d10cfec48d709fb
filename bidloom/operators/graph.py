"""Trees by parent: subtrees, ancestors, neighbourhoods, citation chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth, path) below each root, itself included, at any depth; path sorts depth first in table order.

    nodes: id, parent, ord. From the roots down, a level at a time: what no root reaches is never touched, each level is
    one join of the last with its children, and is written, so that no level is computed again. A cycle below a root raises.
    """
    n = nodes.select("id", "parent", "ord")
    below = n.select(F.col("id").alias("child"), F.col("parent").alias("id"), F.col("ord").alias("o"))
    level = cut(roots.join(n, "id").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("ord").alias("path"), F.array("id").alias("line")), "level")
    out = None
    while True:
        out = level if out is None else out.unionByName(level)
        again = F.array_contains("line", F.col("child"))
        step = level.join(below, "id").select("root", F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("o")).alias("path"), F.array_append("line", F.col("child")).alias("line"), again.alias("again"))
        level = cut(step, "level")
        found = level.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("again"), F.lit(False)).alias("again")).first()
        if found["again"]:
            raise ValueError("nodes above each other form a cycle")
        if not found["n"]:
            return out.select("root", "id", "depth", "path")
        level = level.drop("again")


def ancestor_table(nodes: DataFrame, separator: str = ":") -> DataFrame:
    """(id, ancestor, steps) from path-encoded ids: prefix tests become equi joins."""
    parts = F.split("id", separator)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), separator).alias("ancestor"), (F.size(parts) - i).alias("steps")))
    return nodes.select("id", F.inline(up))


def neighbourhood(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(start, id): the node, its parent, children and siblings."""
    n = nodes.select("id", "parent")
    s = start.join(n, "id").select(F.col("id").alias("start"), "parent")
    up = s.where("parent is not null").select("start", F.col("parent").alias("id"))
    down = s.join(n.withColumnRenamed("parent", "of"), F.col("of") == F.col("start")).select("start", "id")
    beside = s.join(n.withColumnRenamed("parent", "of"), F.col("of") == F.col("parent")).select("start", "id")
    return s.select("start", F.col("start").alias("id")).unionByName(up).unionByName(down).unionByName(beside).distinct()


def resolved(citations: DataFrame, nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """(cite, id, outcome): a chain of (kind, ident) below a scope, level by level. citations: cite, scope, path; nodes: id, kind, ident.

    As many levels as the longest chain has, unless given. An empty level is a miss, more than one match at the end
    ambiguous.
    """
    levels = levels if levels is not None else citations.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    up = ancestor_table(nodes).where("steps > 0").join(nodes, "id").select("id", "ancestor", "kind", "ident")
    now = citations.select("cite", "path", F.col("scope").alias("at"))
    done = None
    for i in range(levels):
        want = F.get("path", F.lit(i))
        end = now.where(want.isNull()).select("cite", F.col("at").alias("id"))
        done = end if done is None else done.unionByName(end)
        step = now.where(want.isNotNull()).withColumn("w", want)
        now = step.join(up, (F.col("at") == F.col("ancestor")) & (F.col("w.kind") == F.col("kind")) & (F.col("w.ident") == F.col("ident"))).select("cite", "path", F.col("id").alias("at"))
    done = done.unionByName(now.where(F.size("path") == levels).select("cite", F.col("at").alias("id"))).distinct()
    n = done.groupBy("cite").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return citations.select("cite").join(n, "cite", "left").select("cite", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("outcome"))
