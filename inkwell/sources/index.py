"""An inverted index of the library: the words of titles and excerpts, kept so that a word or a prefix reads few files.

Postings (head, term, field, report_id, n) are dealt and sorted by range of head, term and report, so a word that most reports
hold is spread over several files, and written in folders by head, the first letters of a folded word. A search names the
heads it needs, which prunes folders, and its words, which prune row groups. New reports are appended.

Words are runs of letters, digits and underscores, without case and accents. Null titles and excerpts have no words;
reports without a word aren't in the index; a report indexed twice is found once; an empty table makes an empty index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import fold, terms_of

HEAD = 2
SCHEMA = "term string, field string, report_id bigint, n bigint, head string"


def head_of(term: Column) -> Column:
    return F.left(term, F.lit(HEAD))


def postings(reports: DataFrame) -> DataFrame:
    """head, term, field, report_id, n: how often each word stands in each field of a report."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), fold(F.col(f)).alias("text")) for f in ("title", "excerpt")))
    rows = reports.select(F.col("id").cast("bigint").alias("report_id"), F.explode(fields).alias("f"))
    words = rows.select("report_id", "f.field", F.explode(F.split(F.coalesce("f.text", F.lit("")), r"[^\p{L}\p{N}_]+")).alias("term")).where("term <> ''")
    return words.groupBy("term", "field", "report_id").agg(F.count("*").alias("n")).select(head_of(F.col("term")).alias("head"), "term", "field", "report_id", "n")


def write(reports: DataFrame, path: str, files: int | None = None) -> None:
    """Add reports (id, title, excerpt) to the index at path. files: into how many ranges they are dealt (by default as many as
    a shuffle has partitions)."""
    order = ("head", "term", "report_id")
    rows = postings(reports)
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("append").partitionBy("head").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def search(index: DataFrame, query: str, field: str | None = None) -> DataFrame:
    """report_id, hits: reports of which a word equals a term of the query or starts with its last one; hits: how many do.
    An empty query finds nothing."""
    terms = terms_of(query)
    if not terms:
        return index.where("false").groupBy("report_id").agg(F.sum("n").alias("hits"))
    *whole, start = terms
    heads = F.col("head").isin(sorted({t[:HEAD] for t in whole} | ({start[:HEAD]} if len(start) >= HEAD else set())))
    folders = heads | F.col("head").startswith(start) if len(start) < HEAD else heads
    wanted = F.col("term").startswith(start) | F.col("term").isin(whole) if whole else F.col("term").startswith(start)
    rows = index.where(folders & wanted)
    return (rows.where(F.col("field") == field) if field else rows).groupBy("report_id").agg(F.sum("n").alias("hits"))
