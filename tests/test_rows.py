"""Documents in their rows against the same rules over rows of lines, words and sentences."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions import tokens
from inkwell.operators import normalise, quality, stats, summary
from inkwell.plans import catalogue
from inkwell.plans import documents as plan

LINES = (
    "", "", "  ", "3", "12", "Page 2", "2 | P a g e", "Run head 1", "Run head 2", "Annual Plan of Cork", "• bullet", "•", "- dash", "1.1 Scope", "1.2 Method ..... 4", "1. Opening words", "2. lower case", "Contents ........ 10",
    "Table 3. Numbers", "Team Member Role", "ABC Anna Byrne", "22 Brian Tester", "plain text", "Costs rose by 12%.", "Note: a.", "Note: b.", "∑x=α+β≈γ≥δ≠ε", "word " * 30 + "end", "naïve été", "HEAD",
)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    pick = lambda some: "\n".join(r.choice(some if r.random() < 0.8 else LINES) for _ in range(r.choice((1, 3, 8, 30))))
    rows = [(i, pick(r.sample(LINES, r.randint(1, 12)))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "a\r\nb\rc")]
    return spark.createDataFrame([*catalogue.PLANTED, *rows], "doc_id long, text string").repartition(4).localCheckpoint()


def test_reports_shuffle_nothing(spark, docs):
    for made in (normalise.prepare(docs), plan.document_reports(docs)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    #: Rows that share an id are documents of their own.
    twice = spark.createDataFrame([(1, "one two"), (1, "three four five")], "doc_id long, text string")
    assert sorted(r.word_count for r in plan.document_reports(twice).collect()) == [2, 3]


def test_lines_are_walked_in_their_rows(docs):
    got = {r.doc_id: r for r in normalise.normalise(docs).collect()}
    marked = normalise.marked_lines(docs)
    blocks, gone = {}, {}
    for r in sorted(normalise.clean_blocks(docs, marked).collect(), key=lambda r: (r.doc_id, r.pos, r.part)):
        blocks.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for r in marked.where("dropped").orderBy("doc_id", "pos").collect():
        gone.setdefault(r.doc_id, []).append(r.line)
    seeds = {r.doc_id: r.seed for r in normalise.furniture(marked).collect()}
    assert len(got) == docs.count() and len(blocks) > 100 and len(gone) > 30 and any(seeds.values())
    for k, r in got.items():
        assert r.removed == gone.get(k, []), k
        if k in blocks:
            assert [tuple(x)[:7] for x in r.blocks] == blocks[k], k
        assert r.header is None or seeds[k] in r.header, k


def test_sentences_are_ranked_in_their_rows(spark, docs):
    more = spark.createDataFrame([(2000, "Note: a. Note: b. Same here. Same  here. Only one."), (2001, "Twice. Twice."), (2002, "A: x. A: y. B: z. B: w. " * 9)], "doc_id long, text string")
    every = docs.unionByName(more)
    want = {}
    for r in summary.ranked_or_lead(summary.sentences(every)).orderBy("doc_id", "rank").collect():
        want.setdefault(r.doc_id, []).append(r.pos)
    rows = every.select("doc_id", summary.sentences_of(F.col("text")).alias("s")).withColumn("again", summary.repeated(F.col("s")))
    got = {r.doc_id: r.p for r in tx.held(rows).select("doc_id", summary.ranked_or_lead_places("s", "again").alias("p")).collect()}
    assert {k: v for k, v in got.items() if v} == want


def test_ranks_are_the_same_all_ways(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (0, 1, 40, 200):
        sets = [sorted({f"t{x}" for x in rng.zipf(1.5, rng.integers(0, 20)) if x < 300}) for _ in range(n)]
        by_terms, by_pairs = summary.rank_scores(sets, 0), None
        for dense in (0, 10**9):
            monkeypatch.setattr(summary, "DENSE", dense)
            by_pairs = summary.rank_scores(sets, 10**9)
            assert np.allclose(by_pairs, by_terms, atol=1e-9), (n, dense)


ODD = ("", "--", "'-", "-a", "a--", "a--\n", "x -\r\n", "it's", "'- b -'", "End. Next", "a.\n\nb", "a.\r\nb!", "x\x0by\x0cz", "…", "né été", "İa yes", "one\u2028two", "two\x85", "a. \0", "?!", "\n", " ", "日本。", "😀. a-", None)


def test_counts_of_bytes(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, t string").coalesce(1)
    t = F.col("t")
    for r in df.select("t", stats.counts_of(stats.valid(t)).alias("c"), tx.word_count(t).alias("w"), tx.sentence_count(t).alias("s"), tx.syllable_count(t).alias("y"), stats.language_of(t).alias("l"), stats.language_by(F.col("w") + 25, F.col("c.l")).alias("k")).collect():
        assert tuple(r.c)[:3] == (r.w, r.s, r.y), r
    rows = df.crossJoin(spark.createDataFrame([(" der die das und " * 9,), (" el los las que y de " * 9,), (" zq zz " * 20,)], "m string")).select(F.concat("t", "m").alias("t"))
    for r in rows.where("t IS NOT NULL").select(stats.language_of(t).alias("l"), stats.counts_of(stats.valid(t)).alias("c")).select("l", stats.language_by(F.col("c.w"), F.col("c.l")).alias("k")).collect():
        assert r.l == r.k


def test_phrases_of_bytes():
    """Against runs of words taken apart one by one."""
    texts = ["Red fox, the red-fox; dog's ▪ hill  and\tblue hill\nnew line 2021 of 5 x9", "❶ one · two the", "", "É Été of ÉTÉ", "a b c", "word\x0bnext 𝐀bc"]
    for text, found in zip(texts, stats.candidates(pa.array(texts), 15), strict=True):
        plain = re.sub(r"\r\n|\r|\n", " . ", "".join(" " if ord(c) in tokens.GLYPHS else c for c in text)).lower()
        kind = lambda c: "w" if tokens.kind_of(ord(c)) or c in "'-" else "s" if c in " \t\x0b\f" else "."
        runs = []
        for piece in "".join(c if kind(c) != "." else "\0" for c in plain).split("\0"):
            runs.append([])
            for w in re.split(r"[ \t\x0b\f]+", piece):
                if w in stats.STOP:
                    runs.append([])
                elif w:
                    runs[-1].append(w)
        runs = [r for r in runs if any(tokens.kind_of(ord(c)) == tokens.LETTER for w in r for c in w)]
        count, degree = Counter(w for r in runs for w in r), Counter()
        for r in runs:
            for w in r:
                degree[w] += len(r)
        want = {" ".join(r): sum(degree[w] / count[w] for w in r) for r in runs if 3 <= len(" ".join(r)) <= 80}
        assert {x["phrase"]: x["score"] for x in found} == pytest.approx(want), text


def test_glyphs_are_the_same():
    listed = re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", quality.GLYPHS))
    assert {i for i in range(1 << 16) if listed.match(chr(i))} == set(tokens.GLYPHS)
