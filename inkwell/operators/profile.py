"""Dataset profiles: types, nulls, distributions, correlations, duplicates, personal data and a quality score.

Every column counts as text, as it would come from a file. One aggregation takes all counts of all columns; order
statistics and types, which look at first values only, take one more each. Rows have an order column, since "the first
thousand values" needs one.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import is_missing, is_numeric

TYPE_SAMPLE, PII_SAMPLE = 1000, 200
BOOLEANS = ("true", "false", "yes", "no")
DATES = (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$", r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2,4}$")
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
POSTCODE = r"(?i)^[AC-FHKNPRTV-Y][0-9]{2}\s?[0-9AC-FHKNPRTV-Y]{4}$"
PHONE = r"^\+?[0-9][0-9 ().-]{6,}$"
NAME_HINT = r"(?i)\b(name|first_?name|last_?name|surname|email|e-?mail|phone|mobile|tel|address|eircode|postcode|zip|ppsn|dob|birth|passport|iban)\b"
STRONG = 0.5
QUARTILES = (0.25, 0.5, 0.75)
#: Accuracy of the sketch that brackets quartiles: a rank is off by one part in so many.
SKETCH = 10_000


def as_text(df: DataFrame, order: str) -> DataFrame:
    """All columns as text beside the order column `_row`."""
    return df.select(F.col(order).alias("_row"), *(F.col(c).cast("string").alias(c) for c in df.columns))


def parse_date(v: Column) -> Column:
    """Dates as year-month-day, month/day/year or day-month name-year; impossible days are none."""
    day = F.split(v, "[ T]")[0]
    formats = ((DATES[0], "yyyy-M-d", day), (DATES[1], "M/d/yyyy", v), (DATES[2], "d-MMM-yyyy", v))
    return F.coalesce(*(F.when(v.rlike(p), F.to_date(F.try_to_timestamp(x, F.lit(f)))) for p, f, x in formats))


def long_form(text: DataFrame, columns: list[str]) -> DataFrame:
    """(row, column, value) of all cells that hold a value; narrow, without a shuffle."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))
    return text.select("_row", F.explode(cells).alias("x")).select("_row", "x.*").where(~is_missing(F.col("value")))


def counts(text: DataFrame, columns: list[str]) -> DataFrame:
    """column, total, count, nulls, null_rate, distinct, cardinality_ratio, constant. Distinct values are exact."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))
    flat = text.select(F.explode(cells).alias("x")).select("x.*").withColumn("value", F.when(~is_missing(F.col("value")), F.lower("value")))
    by_value = flat.groupBy("column", "value").agg(F.count("*").alias("n"))
    out = by_value.groupBy("column").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("count"), F.count("value").alias("distinct"))
    return out.select(
        "column",
        "total",
        "count",
        (F.col("total") - F.col("count")).alias("nulls"),
        F.round((F.col("total") - F.col("count")) / F.col("total"), 4).alias("null_rate"),
        "distinct",
        F.coalesce(F.round(F.try_divide("distinct", "count"), 4), F.lit(0.0)).alias("cardinality_ratio"),
        (F.col("distinct") == 1).alias("constant"),
    )


def first_values(text: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The first n values of each column: each task holds n values of a column at most, and a column is read with its order only."""
    first = lambda c: long_form(text, [c]).orderBy("_row", "value").limit(n)
    return reduce(DataFrame.union, map(first, columns))


def types(text: DataFrame, columns: list[str]) -> DataFrame:
    """column, type, type_agreement: the kind that nearly all of the first thousand values are."""
    v = F.col("value")
    low, bare = F.lower(F.trim(v)), F.regexp_replace(F.trim(v), ",", "")
    integer = bare.rlike(r"^-?[0-9]+$")
    date = reduce(lambda a, b: a | b, (F.trim(v).rlike(p) for p in DATES)) & parse_date(F.trim(v)).isNotNull()
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    agg = first_values(text, columns, TYPE_SAMPLE).groupBy("column").agg(share(low.isin(*BOOLEANS)).alias("b"), share(integer).alias("i"), share(integer | is_numeric(bare)).alias("f"), share(date).alias("d"))
    kind = F.when(F.col("b") >= 0.95, "boolean").when(F.col("i") >= 0.95, "integer").when(F.col("f") >= 0.95, "float").when(F.col("d") >= 0.9, "date").otherwise("string")
    level = F.when(kind == "boolean", F.col("b")).when(kind == "integer", F.col("i")).when(kind == "float", F.col("f")).when(kind == "date", F.col("d")).otherwise(1.0)
    every = text.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    found = agg.select("column", kind.alias("type"), F.round(level, 3).alias("type_agreement"))
    return every.join(F.broadcast(found), "column", "left").select("column", F.coalesce("type", F.lit("empty")).alias("type"), F.coalesce("type_agreement", F.lit(0.0)).alias("type_agreement"))


def number(c: Column) -> Column:
    """The value of a cell as a number, where it is one."""
    bare = F.regexp_replace(F.trim(c), ",", "")
    return F.when(~is_missing(c) & is_numeric(bare), bare.try_cast("double"))


def numbers(text: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x) of all cells that hold a number."""
    return long_form(text, columns).select("column", number(F.col("value")).alias("x")).where("x IS NOT NULL")


def numeric_stats(text: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, max, mean, std, q1, median, q3; quartiles interpolate by rank and are exact.

    A sketch of bounded size brackets each quartile; values are counted by value, and only those within a bracket are
    ranked, so no task sorts a column. The neighbours of a bracket are kept, as a rank may fall just beside it.
    """
    x = numbers(text, columns)
    ends = [p + side * 2 / SKETCH for p in QUARTILES for side in (-1, 1)]
    basic = x.groupBy("column").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.percentile_approx("x", ends, SKETCH).alias("ends"))
    share = F.get(F.array(*map(F.lit, QUARTILES)), F.col("q"))
    brackets = basic.select("column", "n", "ends", F.explode(F.sequence(F.lit(0), F.lit(len(QUARTILES) - 1))).alias("q")).select("column", "q", (share * (F.col("n") - 1)).alias("at"), F.get("ends", 2 * F.col("q")).alias("lo"), F.get("ends", 2 * F.col("q") + 1).alias("hi"))
    by_value = x.groupBy("column", "x").agg(F.count("*").alias("c"))
    placed = by_value.join(F.broadcast(brackets), "column")
    below, above = F.col("x") < F.col("lo"), F.col("x") > F.col("hi")
    sides = placed.groupBy("column", "q").agg(F.sum(F.when(below, F.col("c")).otherwise(0)).alias("under"), F.max(F.when(below, F.col("x"))).alias("before"), F.min(F.when(above, F.col("x"))).alias("after"))
    ranked = placed.where(~below & ~above).withColumn("upto", F.sum("c").over(Window.partitionBy("column", "q").orderBy("x"))).join(F.broadcast(sides), ["column", "q"])
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda rank: (F.col("under") + F.col("upto") - F.col("c") <= rank) & (rank < F.col("under") + F.col("upto"))
    one = lambda name: F.first(name).alias(name)
    found = ranked.groupBy("column", "q").agg(F.max(F.when(holds(low), F.col("x"))).alias("a"), F.max(F.when(holds(high), F.col("x"))).alias("b"), F.max("upto").alias("inside"), *map(one, ("at", "under", "before", "after")))
    value = lambda rank, inside: F.when(rank < F.col("under"), F.col("before")).when(rank >= F.col("under") + F.col("inside"), F.col("after")).otherwise(inside)
    left, right = value(F.floor("at"), F.col("a")), value(F.ceil("at"), F.col("b"))
    quartile = left + (right - left) * (F.col("at") - F.floor("at"))
    per_column = found.select("column", "q", quartile.alias("v")).groupBy("column").agg(*(F.max(F.when(F.col("q") == i, F.col("v"))).alias(name) for i, name in enumerate(("q1", "median", "q3"))))
    return basic.drop("ends").join(F.broadcast(per_column), "column")


def outliers(text: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """column, outliers: values strictly beyond 1.5 interquartile ranges from the quartiles (one row a column joins)."""
    long = numbers(text, columns)
    fences = stats.select("column", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))
    return long.join(F.broadcast(fences), "column").groupBy("column").agg(F.count_if((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))).alias("outliers"))


def lengths(text: DataFrame, columns: list[str]) -> DataFrame:
    """column, min_len, max_len, avg_len in characters."""
    long = long_form(text, columns)
    return long.groupBy("column").agg(F.min(F.length("value")).alias("min_len"), F.max(F.length("value")).alias("max_len"), F.round(F.avg(F.length("value")), 1).alias("avg_len"))


def top_values(text: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """column, rank, value, n: the most frequent values, ties by value."""
    n = long_form(text, columns).groupBy("column", F.lower("value").alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k).select("column", "rank", "value", "n")


def date_range(text: DataFrame, columns: list[str]) -> DataFrame:
    """column, date_min, date_max as text."""
    d = long_form(text, columns).select("column", parse_date(F.trim("value")).alias("d")).where("d IS NOT NULL")
    return d.groupBy("column").agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("date_min"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("date_max"))


def personal(text: DataFrame, columns: list[str]) -> DataFrame:
    """column, pii, pii_reason: half of the first 200 values look like mail, postcodes or phones, or the name says so."""
    v = F.trim("value")
    share = lambda c: F.avg(c.cast("int"))
    phone = v.rlike(PHONE) & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 7)
    agg = first_values(text, columns, PII_SAMPLE).groupBy("column").agg(share(v.rlike(EMAIL)).alias("m"), share(v.rlike(POSTCODE)).alias("e"), share(phone).alias("p"))
    every = text.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    reason = F.when(F.col("m") >= 0.5, "email addresses").when(F.col("e") >= 0.5, "Eircodes").when(F.col("p") >= 0.5, "phone numbers").when(F.col("column").rlike(NAME_HINT), "column name")
    return every.join(F.broadcast(agg), "column", "left").select("column", reason.isNotNull().alias("pii"), F.coalesce(reason, F.lit("")).alias("pii_reason"))


def correlations(text: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r): Pearson's r of each pair of numeric columns over rows that have both, null if under three rows or
    without variance. Cells become numbers once; a row gives its pairs, which are combined in each task."""
    cells = text.select(*(number(F.col(c)).alias(f"x{i}") for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"x{i}").alias("x"), F.col(f"x{j}").alias("y")) for k, (i, j) in enumerate(combinations(range(len(columns)), 2))))
    both = cells.select(F.explode(pairs).alias("p")).select("p.k", F.when(F.col("p.x").isNotNull() & F.col("p.y").isNotNull(), F.col("p.x")).alias("x"), F.when(F.col("p.x").isNotNull(), F.col("p.y")).alias("y"))
    agg = both.groupBy("k").agg(F.count("x").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop(F.when(F.col("x").isNotNull(), F.col("y"))).alias("vy"))
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(columns, 2)))
    spread = F.sqrt(F.col("vx") * F.col("vy"))
    r = F.when((F.col("n") >= 3) & (spread > 0), F.try_divide("c", spread))
    return agg.select(F.get(names, F.col("k")).alias("p"), "n", r.alias("r")).select("p.a", "p.b", "n", "r")


def matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """column and one column for each of `columns`: the square of correlations, to two places, 1.0 on the diagonal, null where a
    pair has none; empty with fewer than two columns."""
    spark = pairs.sparkSession
    r = F.round("r", 2).alias("r")
    itself = spark.createDataFrame([(c, c, 1.0) for c in columns if len(columns) > 1], "a string, b string, r double")
    cells = pairs.select("a", "b", r).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), r)).unionByName(itself)
    return cells.groupBy(F.col("a").alias("column")).pivot("b", columns).agg(F.first("r"))


def strong_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.abs("r") >= STRONG).select("a", "b", F.round("r", 2).alias("r"))


def duplicates(text: DataFrame, columns: list[str]) -> DataFrame:
    """rows, distinct_rows, duplicate_rows, over digests of whole rows."""
    cells = F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    groups = text.select(F.sha2(cells, 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def score(count: DataFrame, kinds: DataFrame, dups: DataFrame) -> DataFrame:
    """completeness, consistency, integrity and the score from 0 to 100."""
    typed = ~F.col("type").isin("string", "empty")
    agg = count.join(kinds, "column").agg((1 - F.avg((F.col("total") - F.col("count")) / F.col("total"))).alias("completeness"), F.coalesce(F.avg(F.when(typed, F.col("type_agreement"))), F.lit(1.0)).alias("consistency"))
    whole = agg.crossJoin(F.broadcast(dups)).withColumn("integrity", 1 - F.coalesce(F.try_divide("duplicate_rows", "rows"), F.lit(0.0)))
    total = F.round(100 * (0.5 * F.col("completeness") + 0.4 * F.col("consistency") + 0.1 * F.col("integrity"))).cast("int")
    return whole.select(F.round("completeness", 6).alias("completeness"), F.round("consistency", 6).alias("consistency"), F.round("integrity", 6).alias("integrity"), total.alias("score"))


def profile(df: DataFrame, order: str) -> DataFrame:
    """The whole profile, one row a column."""
    columns = df.columns
    text = as_text(df, order)
    kinds = types(text, columns)
    stats = numeric_stats(text, columns)
    parts = [kinds, stats.drop("n"), outliers(text, columns, stats), lengths(text, columns), date_range(text, columns), personal(text, columns)]
    out = reduce(lambda a, b: a.join(F.broadcast(b), "column", "left"), parts, counts(text, columns))
    numeric, dated = F.col("type").isin("integer", "float"), F.col("type") == "date"
    for c in ("min", "max", "mean", "std", "q1", "median", "q3"):
        out = out.withColumn(c, F.when(numeric, F.round(c, 4)))
    out = out.withColumn("outliers", F.when(numeric, F.col("outliers")))
    for c in ("date_min", "date_max"):
        out = out.withColumn(c, F.when(dated, F.col(c)))
    for c in ("min_len", "max_len", "avg_len"):
        out = out.withColumn(c, F.when(~numeric & ~dated, F.col(c)))
    return out


def findings(profiled: DataFrame, pairs: DataFrame, dups: DataFrame) -> DataFrame:
    """(g, k, finding): what a reader should know, in order of group g and rank k within it."""
    pct = lambda x: F.concat(F.format_number(100 * x, 1), F.lit("%"))
    column = F.col("column")

    def some(g: int, rows: DataFrame, order: list, *parts) -> DataFrame:
        return rows.select(F.lit(g).alias("g"), F.row_number().over(Window.partitionBy(F.lit(g)).orderBy(*order)).alias("k"), F.concat(*parts).alias("finding"))

    rows = [
        some(1, strong_pairs(pairs), [F.desc(F.abs("r")), "a", "b"], "a", F.lit(" and "), "b", F.lit(" move together, r = "), F.col("r").cast("string")).where("k <= 5"),
        some(2, profiled.where("null_rate >= 0.05"), ["column"], column, F.lit(" is missing in "), pct(F.col("null_rate")), F.lit(" of rows")),
        some(3, profiled.where("outliers > 0"), ["column"], column, F.lit(" has "), F.col("outliers").cast("string"), F.lit(" outliers")),
        some(4, profiled.where("cardinality_ratio >= 0.99 AND count = distinct"), ["column"], column, F.lit(" is unique and may be an identifier")),
        some(5, profiled.where("constant"), ["column"], column, F.lit(" holds one value")),
        some(6, dups.where("duplicate_rows > 0"), ["rows"], F.col("duplicate_rows").cast("string"), F.lit(" rows repeat others")),
    ]
    return reduce(DataFrame.union, rows)


def verdict(profiled: DataFrame, dups: DataFrame) -> DataFrame:
    """One row: issues (columns of mixed types, personal data), notes, verdict, flags. A profile has a row a column."""
    names = lambda rows: F.array_join(F.array_sort(F.filter(F.collect_list(rows), lambda x: x.isNotNull())), ", ")
    mixed = F.concat("column", F.lit(" ("), "type", F.lit(", "), F.format_number(100 * F.col("type_agreement"), 0), F.lit("%)"))
    typed = ~F.col("type").isin("string", "empty")
    agg = profiled.agg(names(F.when(typed & (F.col("type_agreement") < 0.95), mixed)).alias("mixed"), names(F.when(F.col("pii"), F.concat("column", F.lit(" ("), "pii_reason", F.lit(")")))).alias("pii"), F.max("total").alias("rows"))
    whole = agg.crossJoin(F.broadcast(dups.select("duplicate_rows")))
    issues = F.array_compact(F.array(F.when(F.col("mixed") != "", F.concat(F.lit("Mixed-type columns: "), "mixed")), F.when(F.col("pii") != "", F.concat(F.lit("Possible personal data: "), "pii"))))
    notes = F.array(F.concat(F.lit("Types come from the first "), F.lit(str(TYPE_SAMPLE)), F.lit(" values of a column, personal data from the first "), F.lit(str(PII_SAMPLE)), F.lit("; all else from all rows.")))
    flags = F.array_compact(F.array(F.when(F.col("pii") != "", "pii"), F.when(F.col("duplicate_rows") > 0, "duplicates"), F.when(F.col("mixed") != "", "mixed_type")))
    text = F.when(F.size("issues") > 0, F.concat(F.lit("Profiled with "), F.size("issues").cast("string"), F.lit(" issue(s)."))).otherwise("Profiled without issues.")
    return whole.select(issues.alias("issues"), notes.alias("notes"), flags.alias("flags")).withColumn("verdict", text)


def overview(profiled: DataFrame, kept: int | None = None) -> DataFrame:
    """One row: row_count, kept, truncated, columns and a sentence; reading time and the like don't apply to a table."""
    agg = profiled.agg(F.max("total").alias("row_count"), F.count("*").alias("columns"), F.count_if(F.col("type").isin("integer", "float")).alias("numeric"))
    rows = F.col("row_count") if kept is None else F.least(F.col("row_count"), F.lit(kept))
    text = F.concat(F.lit("A table of "), F.col("row_count").cast("string"), F.lit(" rows and "), F.col("columns").cast("string"), F.lit(" columns, "), F.col("numeric").cast("string"), F.lit(" of them numeric."))
    return agg.select("row_count", rows.cast("bigint").alias("kept"), (rows < F.col("row_count")).alias("truncated"), "columns", text.alias("overview"))
