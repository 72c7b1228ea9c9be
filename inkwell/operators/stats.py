"""Statistics, readability, language and key phrases of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from inkwell.functions import tokens
from inkwell.functions.text import sentence_count, syllable_count, word_count

#: Function words by language, for a profile by stop words (fixed values).
LANGUAGES = {
    "en": "the of and to in is that for with as on are was be by this it from or an",
    "fr": "le la de des et les du un une en que qui dans pour pas sur au par est ce",
    "de": "der die das und ist nicht von zu den mit ein eine auf im dem des sich für auch es",
    "es": "el los las que y de en por con para una un se del al lo su como más no",
}
#: English words that end a key phrase (fixed values).
STOP = "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
#: Words that report a change or a conclusion (fixed value).
CHANGE = r"(?i)\b(therefore|thus|conclude[ds]?|significant(ly)?|increase[ds]?|decrease[ds]?|reduced|improved)\b"
FALLBACK_STOP = ("this", "that", "with", "from", "have", "were", "been", "their", "which", "would")


def languages(texts: pa.Array, chars: int = 2000) -> np.ndarray:
    """The language of which each text's first characters have most function words, as its place in LANGUAGES: the first of
    equal ones, so English where there are none."""
    w = tokens.Words(pa.compute.utf8_slice_codeunits(texts, 0, chars), tokens.LETTER)
    hits = [np.bincount(w.row[w.among(known.split())], minlength=len(texts)) for known in LANGUAGES.values()]
    return np.argmax(hits, axis=0)


def valid(text: Column) -> Column:
    """A text as tasks take it."""
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


@F.arrow_udf(StructType([StructField(x, LongType()) for x in "wsyl"]))
def counts_of(texts: pa.Array) -> pa.Array:
    """Words, sentences and syllables of texts, as word_count, sentence_count and syllable_count have them, and languages."""
    parts = [texts.slice(a, b - a) for a, b in tokens.parts(np.diff(tokens.bytes_of(texts)[1]))]
    found = [(*tokens.counts(x), languages(x)) for x in parts]
    values = [np.concatenate([x[i] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in range(4)]
    return pa.StructArray.from_arrays([pa.array(v) for v in values], list("wsyl"))


def readability(text: Column, counts: Column | None = None) -> Column:
    """word_count, character_count (bytes), sentence_count, reading_time_minutes, flesch_reading_ease, as one struct; counts:
    counts_of the text, where it's known."""
    text = F.coalesce(text, F.lit(""))
    if counts is None:
        counts = F.struct(word_count(text).alias("w"), sentence_count(text).alias("s"), syllable_count(text).alias("y"))

    def whole(n: Column) -> Column:
        w, s, y = n["w"], n["s"], n["y"]
        ease = F.when(w == 0, 0.0).otherwise(206.835 - 1.015 * F.try_divide(w, s) - 84.6 * F.try_divide(y, w))
        minutes = F.greatest(F.lit(1), F.ceil(w / 200)).cast("bigint")
        return F.struct(w.alias("word_count"), F.octet_length(text).cast("bigint").alias("character_count"), s.alias("sentence_count"), minutes.alias("reading_time_minutes"), F.round(ease, 1).alias("flesch_reading_ease"))

    return F.get(F.transform(F.array(counts), whole), F.lit(0))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, word_count, character_count (bytes), sentence_count, reading_time_minutes, flesch_reading_ease."""
    return docs.select("doc_id", readability(F.col("text")).alias("s")).select("doc_id", "s.*")


def language_of(text: Column, chars: int = 2000) -> Column:
    """und below 25 words, else the language with most of its function words in the first `chars`, English on none."""
    head = F.split(F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(chars))), r"[^\p{L}]+")

    def hits(t: Column, i: int, lang: str, known: str) -> Column:
        return F.struct(F.size(F.filter(t, lambda x: x.isin(*known.split()))).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang"))

    def best(t: Column) -> Column:
        return F.array_max(F.array(*(hits(t, i, *item) for i, item in enumerate(LANGUAGES.items()))))

    top = F.get(F.transform(F.array(head), best), F.lit(0))
    return F.when(word_count(text) < 25, "und").when(top["n"] == 0, "en").otherwise(top["lang"])


def language_by(words: Column, place: Column) -> Column:
    """language_of from the number of words and the place that counts_of gives."""
    return F.when(words < 25, "und").otherwise(F.get(F.array(*map(F.lit, LANGUAGES)), place.cast("int")))


def language(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", language_of(F.col("text")).alias("language"))


SCORED = ArrayType(StructType([StructField("phrase", StringType()), StructField("score", DoubleType())]))
#: How far scores may be apart that round alike.
NEAR = 0.001


def candidates(texts: pa.Array, k: int) -> list[list[dict]]:
    """Phrases of each text, the maximal runs of words between stop words and punctuation, with the sum of their words' degree
    over frequency: all that can be among the best k when scores are rounded to four places and ties go by phrase."""
    w = tokens.Words(texts, tokens.LETTER | tokens.NUMBER | tokens.MARK, tokens.GLYPH)
    stop = w.among(STOP)
    upto = lambda hit: np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    ends = upto((w.kinds == 0))
    broken = np.ones(len(stop), bool)
    broken[1:] = (w.row[1:] != w.row[:-1]) | (ends[w.begin[1:]] > ends[w.end[:-1]]) | stop[:-1]
    spaced = np.zeros(len(stop), bool)
    spaced[1:] = (w.begin[1:] - w.end[:-1] > 1) | (w.data[w.at[w.end[:-1]]] != 32)
    letters = upto((w.kinds & tokens.LETTER) > 0)
    lettered = letters[w.end] > letters[w.begin]
    kept = np.flatnonzero(~stop)
    run = np.cumsum(broken[kept]) - 1
    #: Runs without a letter are no phrases.
    good = np.bincount(run, lettered[kept])[run] > 0 if len(run) else np.zeros(0, bool)
    kept, run = kept[good], np.unique(run[good], return_inverse=True)[1]
    if not len(kept):
        return [[] for _ in range(len(texts))]
    size, row = np.bincount(run), w.row[kept]
    word = np.unique(row * len(w.names) + w.code[kept], return_inverse=True)[1]
    degree, count = np.bincount(word, size[run]), np.bincount(word)
    score = np.bincount(run, (degree / count)[word])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    chars = np.bincount(run, w.end[kept] - w.begin[kept]).astype(np.int64) + size - 1
    odd = np.bincount(run, spaced[kept] & ~broken[kept]) > 0
    fit = np.flatnonzero((chars >= 3) & (chars <= 80))
    doc = row[first]
    order = fit[np.lexsort((-score[fit], doc[fit]))]
    cuts = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        found, least = {}, 0.0
        for r in order[a:b]:
            if score[r] < least:
                break
            mine = kept[first[r] : first[r] + size[r]]
            phrase = " ".join(w.between(w.begin[i], w.end[i]) for i in mine) if odd[r] else w.between(w.begin[mine[0]], w.end[mine[-1]])
            if phrase not in found:
                found[phrase] = float(score[r])
                least = found[phrase] - NEAR if len(found) == k else least
        out.append([{"phrase": p, "score": s} for p, s in found.items()])
    return out


def rake_of(text: Column, k: int = 15) -> Column:
    """The best k key phrases of a text as an array (phrase, score), the best first; ties by phrase."""

    @F.arrow_udf(SCORED)
    def best(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("phrase", pa.string()), ("score", pa.float64())]))
        ranges = tokens.parts(np.diff(tokens.bytes_of(texts)[1]))
        return pa.concat_arrays([pa.array([], kind), *(pa.array(candidates(texts.slice(a, b - a), k), kind) for a, b in ranges)])

    ordered = F.array_sort(F.transform(best(valid(text)), lambda x: F.struct((-F.round(x["score"], 4)).alias("less"), x["phrase"].alias("phrase"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["phrase"].alias("phrase"), (-x["less"]).alias("score")))


def rake(docs: DataFrame, k: int = 15) -> DataFrame:
    """doc_id, rank, phrase, score: phrases by the sum of their words' degree over frequency; ties by phrase. A row has its whole
    document, so nothing is shuffled."""
    #: An inner explode would make Spark look for empty arrays first, by computing them twice.
    rows = docs.select("doc_id", F.posexplode_outer(rake_of(F.col("text"), k)).alias("at", "p")).where("p IS NOT NULL")
    return rows.select("doc_id", (F.col("at") + 1).alias("rank"), "p.phrase", "p.score")


def frequent_words(docs: DataFrame, k: int = 15) -> DataFrame:
    """doc_id, rank, phrase, score: the most frequent words of four bytes or more; ties by word."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z'-]+"), F.lit(0))).alias("phrase"))
    n = words.where((F.length("phrase") >= 4) & ~F.col("phrase").isin(*FALLBACK_STOP)).groupBy("doc_id", "phrase").agg(F.count("*").cast("double").alias("score"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "phrase"))).where(F.col("rank") <= k).select("doc_id", "rank", "phrase", "score")


def density(text: Column) -> Column:
    """How much a sentence reports: currency, percentages, numbers, verbs of change."""
    return 4 * F.regexp_count(text, F.lit("[€£$]")) + 3 * F.regexp_count(text, F.lit("%")) + 2 * F.regexp_count(text, F.lit(r"\b\d{2,}\b")) + F.regexp_count(text, F.lit(CHANGE))
