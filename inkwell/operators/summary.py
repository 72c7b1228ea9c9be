"""Extractive summaries: sentences, templates, findings, text rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from inkwell.functions import tokens
from inkwell.functions.text import first_words, let, trim

from .stats import STOP, density

SIGNAL = r"(?i)%|\d{2,}|\b(therefore|thus|conclude[ds]?|concluded|significant(ly)?|increase[ds]?|decrease[ds]?|reduced|improved)\b"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve".split()
CAP_BYTES, DAMPING, ROUNDS, KEPT = 40_000, 0.85, 20, 8
#: Cells of a document's matrices up to which ranks are found with them.
DENSE = 20_000
#: Meetings of a term in two sentences up to which a larger document's ranks are found by its pairs; others take sums by term.
CELLS = 1_000_000
#: Pairs that are counted at once.
PAIRS = 2_000_000


def sentences_of(text: Column) -> Column:
    """A text's sentences: split after end marks; empty ones and "0" go."""
    return F.filter(F.split(trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: ~s.isin("", "0"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, sentence: split after end marks; empty ones and "0" go."""
    return docs.select("doc_id", F.posexplode(sentences_of(F.col("text"))).alias("pos", "sentence"))


def signature(s: Column) -> Column:
    """The label before a colon, else the sentence; lower-cased, blanks collapsed. Most have neither a colon nor such blanks."""
    plain = lambda x: F.when(x.rlike(r"\s\s|[^\S ]"), F.regexp_replace(x, r"\s+", " ")).otherwise(x)
    label = F.regexp_extract(s, r"^(.{2,60}?):\s", 1)
    return F.lower(F.when(s.contains(":"), plain(F.coalesce(F.nullif(label, F.lit("")), s))).otherwise(plain(s)))


def templates(found: DataFrame) -> DataFrame:
    """doc_id, signature, n: what a document says twice or more."""
    return found.groupBy("doc_id", signature(F.col("sentence")).alias("signature")).agg(F.count("*").alias("n")).where("n >= 2")


def without_scaffold(found: DataFrame) -> DataFrame:
    """Sentences without templates, or all where fewer than three would stay."""
    w = Window.partitionBy("doc_id")
    rows = found.withColumn("sig", signature(F.col("sentence"))).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "sig")))
    return rows.withColumn("single", F.sum((F.col("n") < 2).cast("int")).over(w)).where("n < 2 OR single < 3").select("doc_id", "pos", "sentence")


def repeated(sentences: Column) -> Column:
    """Of an array of sentences which have another's signature, as an array of booleans, or null if none has. Equal signatures are
    neighbours once they are sorted; only arrays that hold some are."""

    def marked(signs: Column) -> Column:
        by_name = F.array_sort(F.transform(signs, lambda s, i: F.struct(s.alias("sig"), i.alias("at"))))
        near = lambda xs, i, x: F.coalesce(F.get(xs, i)["sig"] == x["sig"], F.lit(False))
        found = let(by_name, lambda xs: F.transform(xs, lambda x, i: F.struct(x["at"].alias("at"), (near(xs, i - 1, x) | near(xs, i + 1, x)).alias("again"))))
        return F.transform(F.array_sort(found), lambda x: x["again"])

    return let(F.transform(sentences, signature), lambda signs: F.when(F.size(F.array_distinct(signs)) < F.size(signs), marked(signs)))


def plain_sentences(docs: DataFrame) -> DataFrame:
    """doc_id and `found`, the array (pos, sentence) that without_scaffold gives of its sentences; a row has its whole document,
    so nothing is shuffled."""

    def plain(parts: Column, again: Column) -> Column:
        rows = F.transform(parts, lambda s, i: F.struct(i.alias("pos"), s.alias("sentence")))
        return let(F.filter(rows, lambda r: ~F.coalesce(F.get(again, r["pos"]), F.lit(False))), lambda single: F.when(F.size(single) < 3, rows).otherwise(single))

    return docs.select("doc_id", let(sentences_of(F.col("text")), lambda parts: let(repeated(parts), lambda again: plain(parts, again))).alias("found"))


def gathered(found: DataFrame) -> DataFrame:
    """doc_id and `found`, the array of its rows (pos, sentence) in order."""
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("found"))


def head(found: DataFrame) -> DataFrame:
    """Whole sentences up to 40 000 bytes a document, as the SQL of scaffold_removed has it; nothing is ranked from these."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return found.withColumn("bytes", F.sum(F.octet_length("sentence")).over(w)).where(F.col("bytes") <= CAP_BYTES).select("doc_id", "pos", "sentence")


def findings(found: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, rank, sentence, score: the densest sentences that report something, equal ones once, earlier first."""
    s = F.col("sentence")
    dates = F.regexp_count(s, F.lit(r"\d{1,2}/\d{1,2}/\d{2,4}"))
    rows = found.where(s.rlike(SIGNAL) & (dates < 2)).withColumn("score", density(s))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", F.lower(F.regexp_replace(s, r"\s+", " "))).orderBy("pos"))).where("nth = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")))
    return ranked.where(F.col("rank") <= k).select("doc_id", "rank", "sentence", "score")


def terms_of(sentence: Column) -> Column:
    """The distinct words of a sentence but stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(sentence), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(*STOP)))


def with_terms(docs: DataFrame) -> DataFrame:
    """doc_id, found (an array of pos and sentence) and the terms of each sentence."""
    return docs.select("doc_id", "found", F.transform("found", lambda x: terms_of(x["sentence"])).alias("terms"))


def flat_terms(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' lists of sentences' lists of terms: where documents begin among sentences, where sentences begin among
    terms, and numbers for the terms."""
    sentences = lists.flatten()
    words = sentences.flatten().dictionary_encode()
    count = lambda x: pa.compute.fill_null(pa.compute.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    begins = lambda x: np.concatenate(([0], np.cumsum(count(x), dtype=np.int64)))
    return begins(lists), begins(sentences), words.indices.to_numpy()


def pair_counts(lists: pa.Array, at_once: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, i, j, weight) of the pairs of sentences of a document that share terms; at most `at_once` meetings of
    a term in two sentences, or those of one sentence, are held together."""
    docs, begins, term = flat_terms(lists)
    size = np.diff(begins)
    where = np.repeat(np.arange(len(size)), size)
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    if not len(term):
        return
    key = doc[where] * (int(term.max()) + 1) + term
    order = np.argsort(key, kind="stable")
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    last = np.searchsorted(key[order], key, side="right")
    met = last - place - 1
    upto = np.concatenate(([0], np.cumsum(met)))[begins]
    log = np.log(np.maximum(size, 2))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + at_once, side="right")) - 1)
        mine = slice(begins[at], begins[end])
        n = met[mine]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        j = where[order[np.repeat(place[mine], n) + 1 + step]]
        pairs, common = np.unique(np.repeat(where[mine], n) * len(size) + j, return_counts=True)
        i, j = pairs // len(size), pairs % len(size)
        yield doc[i], i - docs[doc[i]], j - docs[doc[i]], common / (log[i] + log[j])
        at = end


def pair_weights(docs: DataFrame) -> DataFrame:
    """(doc_id, i, j, weight): shared words of sentence pairs over the logarithms of their sizes (two at least). docs: doc_id and
    found, as plain_sentences or gathered give them; pairs leave a task in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0), batch.column(1)
            begins = found.offsets.to_numpy() - found.offsets[0].as_py()
            pos = found.flatten().to_numpy()
            for doc, i, j, weight in pair_counts(batch.column(2)):
                at = begins[doc]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(pos[at + i]), pa.array(pos[at + j]), pa.array(weight)], names=["doc_id", "i", "j", "weight"])

    rows = with_terms(docs).select("doc_id", F.transform("found", lambda x: x["pos"]).alias("pos"), "terms")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, i int, j int, weight double")


def rank_scores(sets: list[list[str]], cells: int = CELLS) -> np.ndarray:
    """A score a sentence by power iteration over shared terms over the logarithms of both sizes.

    Small documents take a matrix, larger ones the pairs that share terms. Past `cells` neither is made: what sentences of one
    size give a term is summed, then what its terms give a sentence, so memory grows with the text and not with the square of
    its sentences. All ways give the same scores.
    """
    ids: dict = {}
    term = np.array([ids.setdefault(t, len(ids)) for s in sets for t in s], np.int64)
    return scores_of(np.array([len(s) for s in sets], np.int64), term, len(ids), cells)


def meetings(common: np.ndarray, term: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) of different sentences that share terms, both ways and by i, and how many they share."""
    n, where = len(common), np.repeat(np.arange(len(common)), common)
    users = where[np.argsort(term, kind="stable")]
    times = uses[term]
    at = np.arange(times.sum()) + np.repeat((np.cumsum(uses) - uses)[term] - np.cumsum(times) + times, times)
    cell = np.repeat(where * n, times) + users[at]
    if n * n <= 4 * CELLS:
        shared = np.bincount(cell, minlength=n * n)
        cell = np.flatnonzero(shared)
        shared = shared[cell]
    else:
        cell, shared = np.unique(cell, return_counts=True)
    i, j = np.divmod(cell, n)
    apart = i != j
    return i[apart], j[apart], shared[apart]


def scores_of(common: np.ndarray, term: np.ndarray, terms: int, cells: int = CELLS) -> np.ndarray:
    """rank_scores of sentences of `common` terms each; term: these, as numbers below `terms`."""
    n = len(common)
    where = np.repeat(np.arange(n), common)
    size = np.log(np.maximum(common, 2))
    if n * max(n, terms) <= min(cells, DENSE):
        hits = np.zeros((n, max(1, terms)), np.float32)
        hits[where, term] = 1
        weight = (hits @ hits.T) / (size[:, None] + size[None, :])
        np.fill_diagonal(weight, 0)
        total = weight.sum(axis=0)
        given = DAMPING * weight / np.where(total > 0, total, 1)
        score = np.ones(n)
        for _ in range(ROUNDS):
            score = (1 - DAMPING) + given @ score
        return score
    uses = np.bincount(term, minlength=terms)
    if (uses.astype(float) ** 2).sum() <= cells:
        i, j, shared = meetings(common, term, uses)
        weight = shared / (size[i] + size[j])
        given = DAMPING * weight / np.bincount(i, weight, n)[j]
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else i
        score, linked = np.ones(n), i[first]
        for _ in range(ROUNDS):
            new = np.full(n, 1 - DAMPING)
            if len(i):
                new[linked] += np.add.reduceat(given * score.take(j), first)
            score = new
        return score

    def spread(x: np.ndarray) -> np.ndarray:
        out = -common * x / (2 * size)
        for level in np.unique(size):
            by_term = np.bincount(term, np.where(size == level, x, 0)[where], terms)
            out += np.bincount(where, by_term[term], n) / (level + size)
        return out

    total = spread(np.ones(n))
    # A weight is far above this; below are sentences that share nothing, or what rounding leaves of them.
    linked = total > 1e-6
    score = np.ones(n)
    for _ in range(ROUNDS):
        score = (1 - DAMPING) + DAMPING * spread(np.where(linked, score / np.where(linked, total, 1), 0))
    return score


def places(lists: pa.Array) -> list[np.ndarray]:
    """Of each document, a list of sentences, the places of its best ones, the best first."""
    docs = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    w = tokens.Words(lists.flatten(), tokens.LETTER | tokens.NUMBER)
    kept, terms = ~w.among(STOP), max(1, len(w.names))
    once = lambda x: x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x
    sentence, code = np.divmod(once(np.sort(w.row[kept] * terms + w.code[kept])), terms)
    begins = np.searchsorted(sentence, np.arange(docs[-1] + 1))
    out = []
    #: Terms are numbered anew in each document.
    number = np.empty(terms, np.int64)
    for a, b in zip(docs[:-1], docs[1:], strict=True):
        mine = code[begins[a] : begins[b]]
        number[mine] = np.arange(len(mine))
        first = number[mine]
        known = first == np.arange(len(mine))
        own = (np.cumsum(known) - 1)[first]
        score = scores_of(np.diff(begins[a : b + 1]), own, int(known.sum()))
        out.append(np.argsort(-np.round(score, 6), kind="stable")[:KEPT].astype(np.int32))
    return out


def in_parts(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of documents, lists of sentences, that are worked on together."""
    return tokens.parts(np.diff(tokens.bytes_of(lists.flatten())[1][lists.offsets.to_numpy() - lists.offsets[0].as_py()]))


@F.arrow_udf(ArrayType(IntegerType()))
def best_places(lists: pa.Array) -> pa.Array:
    """Of each document, an array of sentences, the places of its best ones, the best first."""
    return pa.array([x for a, b in in_parts(lists) for x in places(lists.slice(a, b - a))], pa.list_(pa.int32()))


def summary_places(lists: pa.Array, again: np.ndarray) -> list[np.ndarray]:
    """places of documents' sentences without templates, as without_scaffold gives them, but no template among the best; or the
    first sentences that aren't templates, or the first ones where all are. again: which sentences are templates."""
    begins = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), np.diff(begins))
    single = np.bincount(doc[~again], minlength=len(lists))[doc]
    kept = np.flatnonzero(~again | (single < 3))
    cuts = np.searchsorted(kept, begins)
    plain = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), lists.flatten().take(pa.array(kept))) if len(kept) < len(again) else lists
    out = []
    for k, best in enumerate(places(plain)):
        at = kept[cuts[k] + best] - begins[k]
        mine = again[begins[k] : begins[k + 1]]
        if mine.any():
            at = at[~mine[at]]
            if not len(at):
                at = (np.arange(len(mine)) if mine.all() else np.flatnonzero(~mine))[:KEPT]
        out.append(at.astype(np.int32))
    return out


@F.arrow_udf(ArrayType(IntegerType()))
def ranked_or_lead_places(lists: pa.Array, marks: pa.Array) -> pa.Array:
    """The places of what ranked_or_lead gives of each document. lists: its sentences; marks: repeated of these."""
    out = []
    for a, b in in_parts(lists):
        some, given = lists.slice(a, b - a), marks.slice(a, b - a)
        again = np.zeros(len(some.flatten()), bool)
        marked = np.repeat(given.is_valid().to_numpy(zero_copy_only=False), np.diff(some.offsets.to_numpy()))
        again[marked] = given.flatten().to_numpy(zero_copy_only=False)
        out += summary_places(some, again)
    return pa.array(out, pa.list_(pa.int32()))


def ranked_sentences(docs: DataFrame) -> DataFrame:
    """doc_id and `ranked`, the array (rank, pos, sentence) of the eight sentences that others resemble most by pair_weights, of
    whole documents. docs: doc_id and found, as plain_sentences or gathered give them; a row has its whole document."""
    placed = docs.select("doc_id", "found", best_places(F.transform("found", lambda x: F.make_valid_utf8(x["sentence"]))).alias("places"))
    one = lambda at, i: F.struct((i + 1).alias("rank"), F.get("found", at)["pos"].alias("pos"), F.get("found", at)["sentence"].alias("sentence"))
    return placed.select("doc_id", F.transform("places", one).alias("ranked"))


def in_rows(ranked: DataFrame) -> DataFrame:
    """doc_id, rank, pos, sentence: one row a sentence."""
    #: An inner explode would make Spark look for empty arrays first, by computing them twice.
    return ranked.select("doc_id", F.explode_outer("ranked").alias("r")).where("r IS NOT NULL").select("doc_id", "r.*")


def text_rank(found: DataFrame) -> DataFrame:
    """doc_id, rank, pos, sentence: ranked_sentences of the rows of documents."""
    return in_rows(ranked_sentences(gathered(found)))


def lead(found: DataFrame, k: int = KEPT) -> DataFrame:
    """The fallback: the first sentences that aren't templates, or the first ones where all are."""
    w = Window.partitionBy("doc_id")
    rows = found.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", signature(F.col("sentence")))))
    rows = rows.withColumn("single", F.sum((F.col("n") < 2).cast("int")).over(w)).where("n < 2 OR single = 0")
    return rows.withColumn("rank", F.row_number().over(w.orderBy("pos"))).where(F.col("rank") <= k).select("doc_id", "rank", "pos", "sentence")


def ranked_or_lead(found: DataFrame) -> DataFrame:
    """doc_id, rank, pos, sentence: a document's ranked sentences without templates, or its lead where none are left."""
    plain = templates(found).select("doc_id", "signature")
    ranked = text_rank(without_scaffold(found)).withColumn("signature", signature(F.col("sentence")))
    both = ranked.join(plain, ["doc_id", "signature"], "left_anti").select("doc_id", F.lit(0).alias("choice"), "rank", "pos", "sentence")
    both = both.unionByName(lead(found).withColumn("choice", F.lit(1)))
    return both.withColumn("best", F.min("choice").over(Window.partitionBy("doc_id"))).where("choice = best").select("doc_id", "rank", "pos", "sentence")


def normal(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def is_genuine(s: Column, furniture: Column) -> Column:
    """Reports something, isn't a row of dates and holds none of the lines (normalised) that aren't prose."""
    dates = F.regexp_count(s, F.lit(r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"))
    return s.rlike(SIGNAL) & (dates < 2) & ((F.size(furniture) == 0) | let(normal(s), lambda n: ~F.exists(furniture, lambda f: n.contains(f))))


def densest(found: Column, k: int = 5) -> Column:
    """The k sentences of an array that report most, equal ones once, earlier first."""
    keyed = F.array_sort(F.transform(found, lambda s, i: F.struct(normal(s).alias("key"), i.alias("at"), s.alias("s"))))
    once = let(keyed, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["key"] != x["key"])))
    scored = F.transform(once, lambda x: F.struct((-density(x["s"])).alias("score"), x["at"].alias("at"), x["s"].alias("s")))
    return F.transform(F.slice(F.array_sort(scored), 1, k), lambda x: x["s"])


def summaries(ranked: DataFrame) -> DataFrame:
    """doc_id, short (five sentences, 150 words), extended (all, 500 words)."""
    return summaries_of(ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("ranked")))


def summaries_of(ranked: DataFrame) -> DataFrame:
    """doc_id, short, extended of ranked_sentences; documents without sentences have none."""
    join = lambda a: F.array_join(F.transform(a, lambda x: x["sentence"]), " ")
    made = F.when(F.size("ranked") > 0, F.array(F.struct(join(F.slice("ranked", 1, 5)).alias("five"), join(F.col("ranked")).alias("every"))))
    texts = ranked.select("doc_id", F.explode_outer(made).alias("t")).where("t IS NOT NULL")
    return texts.select("doc_id", first_words(F.col("t.five"), 150).alias("short"), first_words(F.col("t.every"), 500).alias("extended"))


def joined_words(found: Column, n: int, words: int) -> Column:
    return first_words(F.array_join(F.slice(found, 1, n), " "), words)


def lead_sentence(blocks: Column) -> Column:
    """The first sentence of the first paragraph before any heading, else empty."""
    first = F.get(F.filter(blocks, lambda x: (x["type"] == "heading") | ((x["type"] == "paragraph") & (trim(x["text"]) != ""))), F.lit(0))
    parts = F.filter(F.split(trim(first["text"]), r"(?<=[.!?])\s+"), lambda x: ~x.isin("", "0"))
    return F.when(first["type"] == "paragraph", F.coalesce(F.get(parts, F.lit(0)), trim(first["text"]))).otherwise(F.lit(""))


def template_body(titles: Column) -> Column:
    """`Defines N sections: a; b; c.`"""
    n = F.size(titles)
    word = F.coalesce(F.get(F.array(*map(F.lit, NUMBERS)), n), n.cast("string"))
    return F.concat(F.lit("Defines "), word, F.lit(" sections: "), F.array_join(titles, "; "), F.lit("."))


def templated(headings: DataFrame) -> DataFrame:
    """doc_id, body: `Defines N sections: a; b; c.` for documents that are lists under headings."""
    agg = headings.groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "title"))).alias("hs")).where("n >= 2")
    word = F.coalesce(F.get(F.array(*map(F.lit, NUMBERS)), F.col("n").cast("int")), F.col("n").cast("string"))
    return agg.select("doc_id", F.concat(F.lit("Defines "), word, F.lit(" sections: "), F.array_join(F.transform("hs", lambda x: x["title"]), "; "), F.lit(".")).alias("body"))
