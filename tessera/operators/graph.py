"""Hierarchies and graphs of document parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import kept

def paths(nodes: DataFrame) -> DataFrame:
    """id, path (titles from the root) and depth of nodes (id, parent_id, title), of any depth; nodes on a cycle have no path.

    Each round joins the next level, so the number of rounds is the depth of the hierarchy, not its size.  What hangs
    from a cycle is never reached from a root, so the rounds end.
    """
    nodes = kept(nodes, "nodes")
    level = nodes.filter("parent_id is null").select("id", F.array("title").alias("path"))
    found = level
    while True:
        level = kept(nodes.join(level.select(F.col("id").alias("parent_id"), "path"), "parent_id").select("id", F.concat("path", F.array("title")).alias("path")), "level")
        if level.isEmpty():
            return found.select("id", "path", F.size("path").alias("depth"))
        found = found.unionByName(level)


def islands(marks: DataFrame, group: str, place: str) -> DataFrame:
    """Runs of consecutive places of each group: group, first, last and n."""
    run = F.col(place) - F.row_number().over(Window.partitionBy(group).orderBy(place))
    return marks.select(group, place).distinct().withColumn("run", run).groupBy(group, "run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).drop("run")


def carried(df: DataFrame, group: str, order: str, value: str, alias: str) -> DataFrame:
    """The last value that is not null, up to and with each row."""
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(alias, seen)
