"""References in text: DOIs, addresses and numbered citations, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns and the cap on a document's references.
DOI = r"10\.\d{4,}/[^\s\]]+"
URL = r"""(?i)https?://[^\s)\]"'<>]+"""
NUMBERED = r"\[[\d,\s\-]+\]"
CAP = 100


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, kind (1 DOI, 2 address, 3 numbered), ord, raw, doi, url, key; all hits."""

    def hits(kind: int, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), x.alias("raw")))

    found = F.concat(hits(1, DOI), hits(2, URL), hits(3, NUMBERED))
    rows = docs.select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.*")
    cut = F.rtrim(F.regexp_replace("raw", r"[.,;]+$", ""))
    return rows.select(
        "doc_id",
        "kind",
        "ord",
        "raw",
        F.when(F.col("kind") == 1, F.col("raw")).alias("doi"),
        F.when(F.col("kind") == 1, F.concat(F.lit("https://doi.org/"), F.col("raw"))).when(F.col("kind") == 2, cut).alias("url"),
        F.lower(F.when(F.col("kind") == 2, cut).otherwise(F.col("raw"))).alias("key"),
    )


def listed(text: Column) -> Column:
    """A text's references (raw, doi, url) in one array: the first of each key across kinds, at most a hundred."""

    def hits(kind: int, pattern: str, hint: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))
        return F.when(text.contains(hint), found).when(text.isNotNull(), F.array().cast("array<struct<kind:int,raw:string>>"))

    def keyed(x: Column, i: Column) -> Column:
        cut = F.regexp_replace(x["raw"], r"[.,;]+$", "")
        url = F.when(x["kind"] == 1, F.concat(F.lit("https://doi.org/"), x["raw"])).when(x["kind"] == 2, cut)
        return F.struct(F.lower(F.when(x["kind"] == 2, cut).otherwise(x["raw"])).alias("key"), i.alias("at"), x["raw"].alias("raw"), F.when(x["kind"] == 1, x["raw"]).alias("doi"), url.alias("url"))

    def first(ranked: Column) -> Column:
        once = F.filter(ranked, lambda x, k: (k == 0) | (F.get(ranked, k - 1)["key"] != x["key"]))
        in_order = F.array_sort(F.transform(once, lambda x: F.struct(x["at"].alias("at"), x["raw"].alias("raw"), x["doi"].alias("doi"), x["url"].alias("url"))))
        return F.transform(F.slice(in_order, 1, CAP), lambda x: F.struct(x["raw"].alias("raw"), x["doi"].alias("doi"), x["url"].alias("url")))

    return F.get(F.transform(F.array(F.array_sort(F.transform(F.concat(hits(1, DOI, "10."), hits(2, URL, "://"), hits(3, NUMBERED, "[")), keyed))), first), F.lit(0))


def dedupe(found: DataFrame) -> DataFrame:
    """The first of each key of a document across kinds, at most a hundred, numbered in order."""
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("kind", "ord"))).where("nth = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "ord"))).where(F.col("n") <= CAP).select("doc_id", "n", "raw", "doi", "url")
