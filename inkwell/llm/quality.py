"""Weak supervision of document quality: rules vote, expectation-maximisation weighs them.

Each rule votes for (+1) or against (-1) a document, or abstains (0). The rules' accuracies and the share of good
documents are estimated without labels from how the votes agree, and a document is kept if its posterior probability
of being good reaches a threshold. DataFrame functions only; the estimation runs over counts of vote patterns, of
which there are at most 3 ** (number of rules) whatever the input's size.

Nulls and extremes: a null text counts as empty; an empty text has no words, fails the base rule and isn't kept; a
null id stays null. Texts of any length are taken whole. Repeated rows are scored alike and all returned. An empty
table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Workspace, let, named, unused, words

#: Frequent function words of the corpus languages (fixed values).
FUNCTION_WORDS = "the of and to in is that for with as on are was be le la de des et les du un une en que qui dans der die das und ist nicht von zu den mit ein eine el los las y por con para una".split()


@dataclass(frozen=True)
class Rule:
    """Votes -1 where `bad` holds, else +1 where `good` holds, else abstains. Both are conditions on the measures."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "n_words >= 40"),
    Rule("word_length", "word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words", "word_chars BETWEEN 3.0 * n_words AND 10.0 * n_words"),
    Rule("symbols", "n_symbols > 0.10 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("lines", "n_dup_lines > 0.30 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("function_words", "n_function_words < 0.02 * n_words", "n_function_words >= 0.06 * n_words"),
    Rule("letters", "n_letter_words < 0.70 * n_words", "n_letter_words >= 0.90 * n_words"),
    Rule("sentences", "n_ends * 200 < n_words", "n_ends * 40 >= n_words"),
)


def repeated_words(tokens: Column, width: int = 8) -> Column:
    """Words that lie in windows of `width` words found twice or more in the text, the first window included."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - (width - 1)), lambda _, i: F.xxhash64(F.slice(hashes, i + 1, F.lit(width))))

    def covered(found: Column) -> Column:
        ranked = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(r: Column) -> Column:
            same = F.filter(r, lambda x, k: (F.get(r, k - 1)["h"] == x["h"]) | (F.get(r, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return let(ranked, lambda r: F.aggregate(twice(r), start, lambda acc, p: F.struct((acc["n"] + p + width - F.greatest(p, acc["end"])).alias("n"), (p + width).alias("end")), lambda acc: acc["n"]))

    count = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(0)))
    return F.when(F.size(tokens) > width, count).otherwise(0).cast("bigint")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document with the counts that the rules look at, and the columns to carry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    known = F.array(*map(F.lit, FUNCTION_WORDS))
    base = docs.select(F.col(id_col).alias("doc_id"), *carry, text.alias("text"), words(F.col(text_col)).alias("w"), lines.alias("l"))
    long = lambda x: x.cast("bigint")
    return base.select(
        "doc_id",
        *carry,
        long(F.size("w")).alias("n_words"),
        long(F.length(F.regexp_replace("text", SPACE_CLASS + "+", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        long(F.size("l")).alias("n_lines"),
        long(F.size(F.filter("w", lambda x: F.array_contains(known, F.lower(x))))).alias("n_function_words"),
        long(F.size(F.filter("w", lambda x: x.rlike(r"\p{L}")))).alias("n_letter_words"),
        long(F.regexp_count("text", F.lit(r"[.!?]"))).alias("n_ends"),
    )


def votes(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    def vote(r: Rule) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).cast("tinyint")

    return measured.withColumn("votes", F.array(*(vote(r) for r in rules)))


@dataclass(frozen=True)
class Model:
    """share: of good documents. For each rule, how often its votes are right on good and on bad documents."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self) -> Column:
        """Probability of a good document, given its votes; an abstention doesn't move it."""
        weights = [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(self.on_good, self.on_bad, strict=True)]
        return posterior(F.col("votes"), F.lit(math.log(self.share / (1 - self.share))), *(F.array(*map(F.lit, side)) for side in zip(*weights, strict=True)))


def posterior(votes: Column, prior: Column, plus: Column, minus: Column) -> Column:
    """Log odds of a good document: the prior's, and for each vote for or against it that rule's weight."""
    moved = F.zip_with(votes, F.arrays_zip(plus.alias("p"), minus.alias("m")), lambda v, w: F.when(v == 1, w["p"]).when(v == -1, w["m"]).otherwise(F.lit(0.0)))
    return 1 / (1 + F.exp(-F.aggregate(moved, prior, lambda total, x: total + x)))


#: Where the estimation starts, and the weight in votes (of PRIOR documents) that keeps rare votes from extremes.
START = Model(0.85, (0.97,), (0.4,))
PRIOR = 10.0
ROUNDS = 15


def fit(voted: DataFrame, n_rules: int, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the counts of vote patterns.

    Rules look at different faults, so a bad document passes most of them: accuracies are estimated by class, and kept
    on the side where a vote against makes a bad document likelier. The counts (at most 3 ** n_rules) meet in one row;
    all rounds are one expression over it, with the parameters as its state.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("ps"))
    total = lambda parts, of: F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + of(x))
    clamp = lambda x, low, high: F.least(F.lit(high), F.greatest(F.lit(low), x))
    log_odds = lambda a, b: F.zip_with(a, b, lambda x, y: F.ln(x / y))
    less = lambda a: F.transform(a, lambda x: 1 - x)

    def expected(m: Column) -> Column:
        """Of each pattern the votes, and how many good and bad documents it stands for."""
        weights = F.struct(log_odds(m["on_good"], less(m["on_bad"])).alias("plus"), log_odds(less(m["on_good"]), m["on_bad"]).alias("minus"))

        def split(w: Column) -> Column:
            good = lambda x: posterior(x["votes"], F.ln(m["share"] / (1 - m["share"])), w["plus"], w["minus"])
            return F.transform("ps", lambda x: let(good(x), lambda p: F.struct(x["votes"].alias("votes"), (x["n"] * p).alias("good"), (x["n"] * (1 - p)).alias("bad"))))

        return let(weights, split)

    def maximised(parts: Column) -> Column:
        rules = F.sequence(F.lit(0), F.lit(n_rules - 1))

        def right(i: Column, kind: str, vote: int, start: float) -> Column:
            of = lambda on: total(parts, lambda x: F.when(on(F.get(x["votes"], i)), x[kind]).otherwise(F.lit(0.0)))
            return (of(lambda v: v == vote) + PRIOR * start) / (of(lambda v: v != 0) + PRIOR)

        good = F.transform(rules, lambda i: clamp(right(i, "good", 1, START.on_good[0]), 0.6, 0.995))
        bad = lambda g: F.transform(rules, lambda i: clamp(F.greatest(1.5 * (1 - F.get(g, i)), right(i, "bad", -1, START.on_bad[0])), 0.02, 0.98))
        n_good, n_bad = (total(parts, lambda x, k=k: x[k]) for k in ("good", "bad"))
        share = clamp((n_good + PRIOR * START.share) / (n_good + n_bad + PRIOR), 0.02, 0.98)
        return let(good, lambda g: F.struct(share.alias("share"), g.alias("on_good"), bad(g).alias("on_bad")))

    first = F.struct(F.lit(START.share).alias("share"), F.array_repeat(F.lit(START.on_good[0]), n_rules).alias("on_good"), F.array_repeat(F.lit(START.on_bad[0]), n_rules).alias("on_bad"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda m, _: let(expected(m), maximised))
    row = patterns.select(model.alias("m")).first()["m"]
    return Model(row["share"], tuple(row["on_good"]), tuple(row["on_bad"]))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to carry, the measures, votes, quality (posterior probability), base_failed and kept, one row a document.

    The measures are written once to the shared folder, as the estimation and the result both read them.
    """
    ws = Workspace(docs.sparkSession, "quality")
    voted = ws.cut(votes(measures(docs, id_col, text_col, carry), rules))
    model = fit(voted, len(rules))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select("*", model.posterior().alias("quality"), failed.alias("base_failed")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows are told apart by two hashes of id and text."""
    key = unused(docs, "k1", "k2")
    keyed = docs.withColumns({key[0]: F.xxhash64(id_col, text_col), key[1]: F.xxhash64(F.lit(3), id_col, text_col)})
    good = score(keyed, rules, threshold, id_col, text_col, tuple(key)).where("kept").select(*key)
    return keyed.join(good, key, "left_semi").select(*map(named, docs.columns))
