r"""Phrase collocations by suffix automata of shards.

A task gathers texts into shards by language and builds over each a generalised suffix automaton of its words, bounded to the
depth of the longest phrase and level by level: a state of level k is a state of level k - 1 and a next word, its suffix
link is the state of its last k - 1 words, and its endpos count is the number of places in pieces where it ends. The
states are the shard's phrases; their counts are summed over all shards by a shuffle. Levels 1 and 2 are counted first; a longer
phrase can only reach the least count if both its phrases of one word less do, so a shard hands on only those states
whose transition source and suffix link may be frequent: they are looked up in a bitmap of the frequent phrases of the level below, a
bitmap of at most `MOST_BITS` bits that may let others through but loses none.

Then everything is joins over the frequent phrases: every cut of a candidate gets the counts of its parts and an exact score in
decimals, the lowest stays; candidates are dropped by a longer phrase that they are the suffix link or the transition source
of, and so up level by level. The best of a language are ranked in two steps, over hashed parts and over their winners.

Nulls and extremes: a null or empty text has no words; a null language is `und`; ids aren't used; a phrase can't cross a
piece's end; texts of any length are read whole; repeated rows count as often as they occur; an empty table gives an empty
result; extra columns are ignored. Scores are exact for counts below 10 ** 14.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

UND = "und"
#: Lower case, piece ends to line feeds, tabs to spaces (bytes of UTF-8).
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + 9 * b"\n")
#: Bytes of text in a shard; bits of the bitmap for a frequent phrase, and its largest size (16 MB).
SHARD, BITS_EACH, MOST_BITS = 5_000_000, 16, 1 << 27
#: Rows of a batch that are looked at, or handed on, at once.
ROWS, OUT = 500, 100_000
#: Parts of a language whose best phrases are found apart.
PARTS = 64
MIX = 1_000_003


class Automaton:
    """The automaton of a shard to a given depth. words: its distinct words; of level k (from 0): last and source, which give a
    state's last word and its source's number, link, its suffix link's number, and count, its endpos count."""

    def __init__(self, texts: list[bytes], depth: int):
        tokens = b" \n ".join(texts).translate(FOLD).replace(b"\n", b" \n ").split(b" ")
        parts = [pa.array(tokens[at : at + OUT], pa.binary()) for at in range(0, len(tokens), OUT)]
        del tokens
        coded = pa.concat_arrays(parts).dictionary_encode()
        del parts
        words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        plain = np.array([w not in (b"", b"\n") for w in words], bool) if words else np.empty(0, bool)
        empty = words.index(b"") if b"" in words else -1
        ids = ids[ids != empty]
        number = np.cumsum(plain) - 1
        #: -1: the end of a piece.
        place = np.where(plain[ids], number[ids], -1) if len(ids) else ids
        self.words = pa.array([w for w, p in zip(words, plain, strict=True) if p], pa.binary())
        n = len(self.words)
        self.total = int((place >= 0).sum())
        self.last, self.source, self.link, self.count = [np.arange(n)], [np.zeros(n, np.int64)], [np.zeros(n, np.int64)], [np.bincount(place[place >= 0], minlength=n)]
        state = place
        for _ in range(1, depth):
            if len(state) < 2:
                state = np.empty(0, np.int64)
            #: state: of the phrase that starts at each place, or -1; here one word is put to its end.
            step = place[len(place) - len(state) + 1 :] if len(state) else state
            here = state[:-1] if len(state) else state
            ok = (here >= 0) & (step >= 0)
            key = here[ok] * max(n, 1) + step[ok]
            code, distinct = pd.factorize(key)
            new = np.full(len(here), -1, np.int64)
            new[ok] = code
            at = np.empty(len(distinct), np.int64)
            at[code] = state[1:][ok] if len(state) else state
            self.last.append(distinct % max(n, 1))
            self.source.append(distinct // max(n, 1))
            self.link.append(at)
            self.count.append(np.bincount(code, minlength=len(distinct)))
            state = new

    def phrases(self, level: int, states: np.ndarray) -> pa.Array:
        """The words of states of a level, joined by spaces."""
        parts = []
        for k in range(level, -1, -1):
            parts.append(self.words.take(pa.array(self.last[k][states])))
            states = self.source[k][states]
        return pa.compute.binary_join_element_wise(*parts[::-1], pa.scalar(b" ", pa.binary())) if level else parts[0]

    def buckets(self, level: int, lang: str, bits: int) -> np.ndarray:
        """Each state's bit in a bitmap, from the check sums of its words; `bucket` says the same of a row."""
        salt = zlib.crc32(lang.encode())
        sums = np.array([zlib.crc32(w) for w in self.words.to_pylist()], np.int64)
        at = (sums + salt) % bits
        for k in range(1, level + 1):
            at = (at[self.source[k]] * MIX + sums[self.last[k]]) % bits
        return at


def bucket(lang: str, phrase: str, bits: int) -> str:
    """SQL of the bit of a phrase."""
    return f"aggregate(split({phrase}, ' '), CAST(NULL AS BIGINT), (at, w) -> CASE WHEN at IS NULL THEN (crc32(CAST(w AS BINARY)) + crc32(CAST({lang} AS BINARY))) % {bits} ELSE (at * {MIX} + crc32(CAST(w AS BINARY))) % {bits} END)"


def counted(docs: DataFrame, levels: tuple[int, ...], shard: int, bitmap=None) -> DataFrame:
    """(lang, phrase, n), summed: phrases of the given numbers of words. With level 1 comes an empty phrase that counts all words.
    bitmap: a broadcast array of 64-bit words, of the frequent phrases of one word less than the one level asked for."""
    deepest = max(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        size = 0

        def row(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), phrases.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])

        def shard_rows() -> Iterator[pa.RecordBatch]:
            for lang in list(texts):
                made = Automaton(texts.pop(lang), deepest)
                if 1 in levels:
                    yield row(lang, pa.array([b""], pa.binary()), np.array([made.total]))
                for level in levels:
                    k = level - 1
                    states = np.arange(len(made.count[k]))
                    if bitmap is not None:
                        held = bitmap.value
                        at = made.buckets(k - 1, lang, 64 * len(held))
                        often = (held[at >> 6] >> (at & 63) & 1).astype(bool)
                        states = np.flatnonzero(often[made.source[k]] & often[made.link[k]])
                    for i in range(0, len(states), OUT):
                        some = states[i : i + OUT]
                        yield row(lang, made.phrases(k, some), made.count[k][some])
                del made
                pa.default_memory_pool().release_unused()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for lang, text in zip(batch.column(0).slice(at, ROWS).to_pylist(), batch.column(1).slice(at, ROWS).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(text)
                    size += len(text)
                    if size > shard:
                        yield from shard_rows()
                        size = 0
        yield from shard_rows()

    return docs.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_bits(spark: SparkSession, phrases: DataFrame):
    """A broadcast bitmap of phrases (lang, phrase): one bit each, at most MOST_BITS in all, whatever their number."""
    bits = 1 << 13
    n = phrases.count()
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits *= 2
    at = phrases.select(F.expr(bucket("lang", "phrase", bits)).alias("at")).groupBy(F.expr("at >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("value"))
    held = np.zeros(bits // 64, np.int64)
    got = at.toArrow()
    held[got.column("word").to_numpy()] = got.column("value").to_numpy()
    return spark.sparkContext.broadcast(held)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to most_words words.

    a, l, r, n: occurrences of the phrase, of the parts of its lowest-scoring cut, of all words. least: of a candidate.
    share: a candidate goes if a longer phrase around it has this percentage of its occurrences.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kept = F.col("n") >= least
    levels = [ws.cut(counted(texts, (1, 2), shard).where(kept | (F.col("phrase") == "")))]
    below = levels[0].where("instr(phrase, ' ') > 0")
    for k in range(3, most_words + 1):
        below = ws.cut(counted(texts, (k,), shard, frequent_bits(spark, below)).where(kept))
        levels.append(below)
    found = levels[0]
    for x in levels[1:]:
        found = found.union(x)
    part = found.where("phrase <> ''")

    #: Of a cut the words before and after; a phrase of m words has m - 1 cuts.
    long = part.where("instr(phrase, ' ') > 0").withColumn("w", F.split("phrase", " "))
    cuts = long.select("lang", "phrase", F.col("n").alias("a"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(F.array_join(F.slice("w", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("tail")))).alias("k", "cut"))
    head, tail = (part.select("lang", F.col("phrase").alias(x), F.col("n").alias(y)) for x, y in (("head", "l"), ("tail", "r")))
    cuts = cuts.select("lang", "phrase", "a", "k", "cut.head", "cut.tail").join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    exact = "CAST({} AS DECIMAL(14, 0))"
    score = F.expr(f"CAST(({exact.format('a')} * {exact.format('a')} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({exact.format('l')} * {exact.format('r')}) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("low"))

    #: What lies inside a longer phrase: its suffix link and its transition source, and theirs.
    inside = long.where("size(w) > 2").select("lang", F.col("n").alias("around"), F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    open_ = scored.join(around, ["lang", "phrase"], "left").where(f"around IS NULL OR 100 * around < {share} * a")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = open_.select("lang", "phrase", "a", "low.l", "low.r", "low.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = levels[0].where("phrase = ''").select(F.col("lang").alias("of_lang"), F.col("n").alias("words"))
    return ranked.join(totals, F.col("lang") == F.col("of_lang")).select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
