"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import lines, mixing, nearjoin, pieces, quality
from inkwell.llm.common import SPACE_CLASS, Workspace, named, table, unused
from inkwell.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule (null and empty texts among them) or are probably bad go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go, and documents of which no word is left (null texts among them); n_chars follows."""
    cleaned = lines.dedup_lines(docs, counts=tuple(unused(docs, "lines", "dropped"))).where(F.col("text").rlike(f"(?!{SPACE_CLASS})(?s:.)"))
    size = F.length("text").cast("bigint")
    return cleaned.select(*(size.alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once if its row is repeated.

    A row without an id takes part under a number hashed from its text, above 2 ** 62, so that it yields to copies with
    an id and stays if it links with nothing. Rows that share an id but differ in text are parts of one document.
    """
    key, text = unused(docs, "key", "digest")
    keyed = docs.withColumns({key: F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)), text: F.xxhash64(F.lit(7), "text")})
    kept = nearjoin.near_duplicates(keyed, id_col=key).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key, text]).select(*map(named, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or drop out, so that sources have their target shares; the order is a global shuffle.

    A null source is a source of its own; rows without an id share one number of copies.
    """
    return mixing.mix_sources(docs, names=tuple(unused(docs, "copies", "copy"))).select(*map(named, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text: doc_id, source, ids, n_tokens, restored; an empty text has no pieces."""
    return pieces.encode(docs, vocabulary(), ("doc_id", "source"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("mix_sources", mix), ("sentencepiece", encode)]

#: EM's posteriors, parity sketches and piece merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the table of a stage is deleted when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for _, stage in STAGES:
        before, docs = docs, ws.cut(stage(spark, docs, sf_dir))
        ws.drop(before)
    return docs
