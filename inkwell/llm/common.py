"""Helpers shared by the corpus operators: column expressions and shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.tables import spread
from inkwell.sources.workspace import Workspace

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even if lambdas in the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text as an array; a null or blank text has none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_CLASS + "+", -1))


def prefix_sums(values: Column, block: int = 64) -> Column:
    """Inclusive running sums of an array of longs, by blocks so that long arrays stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def blocks(a: Column) -> Column:
        last = F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(a, b * block + 1, block)))

    def run(a: Column, before: Column) -> Column:
        return F.transform(a, lambda _, i: F.get(before, F.floor(i / block).cast("int")) + total(F.slice(a, i - i % block + 1, i % block + 1)))

    def starts(sums: Column) -> Column:
        return F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))

    return let(values, lambda a: let(blocks(a), lambda sums: let(starts(sums), lambda before: run(a, before))))


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Nodes of an undirected edge list (a, b) with the smallest node that each can reach.

    Minimum labels spread to neighbours, then labels jump to their label's label, so that chains shorten by halves.
    All rounds are joins and aggregations over tables; the driver sees one count a round. An aggregation by node
    combines before its shuffle, so a node with very many edges doesn't gather them in a task.
    """
    both = ws.cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = ws.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        parent = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = ws.cut(step.join(parent, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        ws.drop(labels)
        labels = new
        if not moved:
            ws.drop(both)
            return labels.select("node", F.col("label").alias("component"))
