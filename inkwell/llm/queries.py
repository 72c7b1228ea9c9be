"""The operators applied to their whole tables: op<N>_<name>(spark, sf_dir), and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, collocations, lines, mixing, nearjoin, nearvec, pagetext, pieces, pii, ppm, quality, warc
from .common import Workspace, table
from .sql import SQL  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    formatted = chat.format_chats(turns.unionByName(spark.createDataFrame(probe, "conv_id bigint, turn bigint, role string, text string")))
    read = formatted.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary() -> pieces.Vocabulary:
    import public_tokenizers

    return pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary())


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = [F.col(k.name) for k in pii.BASE]
    counts = [F.size(c).cast("bigint").alias(f"n_{k.name}") for c, k in zip(base, pii.BASE, strict=True)]
    every = F.concat(*base, *(F.col(k.name) for k in pii.ADDED))
    return found.select("doc_id", *counts, F.sha2(pii.digest_of(F.concat(*base)), 256).alias("base_sha256"), pii.digest_of(every).alias("spans"), pii.scores_of(every).alias("scores"), F.size(every).cast("bigint").alias("n_spans"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "copy", "copies", "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "warc").base
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    first, second = align.byte_level(public_tokenizers.path("byte_bpe_50k.json")), align.piece_level(public_tokenizers.path("piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), first, second)


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_chat_format, op3_ngram_jaccard, op4_sentencepiece, op5_lm_score, op6_pii, op7_mix_sources, op8_line_dedup, op9_warc, op10_embedding_near_dedup, op11_collocations, op12_token_alignment, op13_page_text)
}
