"""The library of reports: search, paging, duplicates, and merging of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import fold, terms_of

PAGE = 20


def as_reports(docs: DataFrame) -> DataFrame:
    """Library rows of documents; the id gives the time of creation."""
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)
    first = F.trim(F.split("text", "\n")[0])
    return docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"), F.left(first, F.lit(255)).alias("title"), F.upper("lang").alias("source_type"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.left("text", F.lit(500)).alias("excerpt"), stamp.alias("created_at"))


def search(reports: DataFrame, query: str) -> DataFrame:
    """Reports of which a word equals a term of the query or starts with its last one, whatever the case and accents: a scan, for
    libraries without an index (`inkwell.sources.index`). An empty query finds nothing."""
    terms = terms_of(query)
    words = F.split(fold(F.concat_ws(" ", "title", "excerpt")), r"[^\p{L}\p{N}_]+")
    return reports.where(F.exists(words, lambda w: w.isin(terms[:-1]) | w.startswith(terms[-1])) if terms else F.lit(False))


def page(reports: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of the newest reports first; a top-k, not a sort of everything."""
    return reports.orderBy(F.desc("created_at"), F.desc("id")).limit(number * size).orderBy(F.desc("created_at"), F.desc("id")).offset((number - 1) * size)


def duplicates(reports: DataFrame) -> DataFrame:
    """id, earliest, latest: the first and last report with the same fingerprint, where there are others."""
    groups = reports.groupBy("fingerprint").agg(F.min(F.struct("created_at", "id"))["id"].alias("earliest"), F.max("id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    return reports.select("id", "fingerprint").join(groups, "fingerprint").select("id", "earliest", "latest")


def select_ids(reports: DataFrame, ids: list[int]) -> DataFrame:
    """The chosen reports in the order given, each once, missing ones skipped."""
    order = list(dict.fromkeys(ids))
    wanted = reports.sparkSession.createDataFrame(list(enumerate(order)), "ord int, id bigint")
    return reports.join(F.broadcast(wanted), "id")


def merge_keyphrases(phrases: DataFrame, k: int = 30) -> DataFrame:
    """phrase, score: sums over reports, case and accents aside, the greatest first."""
    key = F.collate(F.lower("phrase"), "UNICODE_CI_AI")
    sums = phrases.select(key.alias("key"), F.lower("phrase").alias("phrase"), "score").groupBy("key").agg(F.min("phrase").alias("phrase"), F.round(F.sum("score"), 4).alias("score"))
    return sums.select("phrase", "score").orderBy(F.desc("score"), "phrase").limit(k)


def merge_references(refs: DataFrame, order: Column) -> DataFrame:
    """The first reference of each key: DOI, else address, else the raw text."""
    key = F.coalesce(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("url:"), F.lower("url")), F.concat(F.lit("raw:"), F.lower(F.trim("raw"))))
    first = refs.withColumn("key", key).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(order, "n")))
    return first.where("nth = 1").select("doc_id", "n", "raw", "key")


def sections(markdown: DataFrame) -> DataFrame:
    """doc_id, section, title, body: a report split at second-level headings, what precedes them dropped."""
    lines = markdown.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.col("line").rlike(r"^##\s+")
    rows = lines.withColumn("section", F.sum(head.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))).where("section > 0")
    agg = rows.groupBy("doc_id", "section").agg(F.max(F.when(head, F.regexp_replace("line", r"^##\s+", ""))).alias("title"), F.sort_array(F.collect_list(F.when(~head, F.struct("pos", "line")))).alias("ls"))
    return agg.select("doc_id", "section", "title", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body"))


def renumber(title: Column, report: Column) -> Column:
    """`3. Topic` in report 2 becomes `2.3 Topic`."""
    return F.when(title.rlike(r"^\d+\.\s+"), F.concat(report.cast("string"), F.lit("."), F.regexp_replace(title, r"^(\d+)\.\s+", "$1 "))).otherwise(title)


def by_job(reports: DataFrame, jobs: DataFrame) -> DataFrame:
    """The reports of jobs (job_id)."""
    return reports.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
