"""Mixing sources to target weights by Poisson replication.

A source of n documents and target share w of N * epochs rows repeats each of its documents w * N * epochs / n times on
average. A document's number of copies inverts the Poisson distribution with that mean at a uniform number hashed from
its id and a seed, so it depends on nothing else in the table and a rerun of a lost task gives the same rows. Each copy
is a row; a hash of id, copy and seed deals the rows out to partitions and orders them there, which shuffles globally.

Rates are joined on (source, salt), so that a source with a third of all rows is dealt over many tasks; rates of at
most `SMALL` sources, counted first, are broadcast instead.

Nulls and extremes: a null source is a source of its own; a null id is hashed as an empty string; null and long texts
pass through; repeated rows get equal numbers of copies each; weights given for absent sources are ignored and sources
without a weight get none; an empty table gives an empty result. Extra columns are kept, whatever their names; `copies`
and `copy` are added, in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, unused

SMALL = 10_000
SALTS = 64
POWER = 0.7


def uniform(seed: int, key: Column) -> Column:
    """In [0, 1), from 52 bits of a digest of seed and key."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), F.lit(1), F.lit(13)), 16, 10).cast("bigint") / float(1 << 52)


def cumulative(rate: Column) -> Column:
    """The distribution's cumulative probabilities from 0 up to where they reach one, computed by logarithms."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, power: float, source_col: str) -> DataFrame:
    """source, rate and its cumulative probabilities. Without weights, shares are the sources' sizes to a power."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow("n", F.lit(power)))
    else:
        given = sizes.sparkSession.createDataFrame(list(weights.items()), "name string, w double")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("w").alias("sum_w"), F.sum("n").alias("sum_n"))
    mean = F.coalesce(F.try_divide(F.col("w"), F.col("sum_w")), F.lit(0.0)) * F.col("sum_n") * epochs / F.col("n")
    return weighed.join(F.broadcast(total)).select("source", mean.alias("rate")).withColumn("steps", F.when(F.col("rate") > 0, cumulative(F.col("rate"))).otherwise(F.array(F.lit(1.0))))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, power: float = POWER, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", names: tuple[str, str] = ("copies", "copy")) -> DataFrame:
    """The documents' columns, with a row for each copy, the number of copies and its own (`names`), globally shuffled."""
    source, steps, salt, u, order = unused(docs, "source", "steps", "salt", "u", "order")
    table = rates(docs, weights, epochs, power, source_col).select(F.col("source").alias(source), F.col("steps").alias(steps))
    same = named(source_col).eqNullSafe(named(source))
    if table.limit(SMALL + 1).count() <= SMALL:
        joined = docs.join(F.broadcast(table), same)
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same & (dealt[salt] == salted[salt]))
    kept = [named(c) for c in docs.columns if c.lower() not in names]
    key = F.col(id_col)
    counted = joined.select("*", uniform(seed, key).alias(u)).select(*kept, key.alias(order), F.size(F.filter(named(steps), lambda c: c <= named(u))).alias(names[0]))
    copies = counted.where(named(names[0]) > 0).withColumn(names[1], F.explode(F.sequence(F.lit(1), named(names[0]))))
    copies = copies.withColumn(order, F.xxhash64(F.lit(seed), named(order), named(names[1])))
    return copies.repartition(named(order)).sortWithinPartitions(named(order)).drop(order)
