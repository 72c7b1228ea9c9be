r"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score. DataFrame functions only.

The base kinds are email, ip, card and phone: leftmost non-overlapping matches, dropped without another try if the parts
of an address exceed 255, the digits fail Luhn or their number is wrong. Added kinds (iban by mod 97, ssn by its ranges,
keys by their issuers' formats, secrets by being long and mixed, passport numbers) count only if their score reaches a
threshold; a word of the kind's context within `NEAR` code points raises it, and the weaker kinds need one.

What stands near a match is cut from the text's blocks, not from the whole text, so the time grows with text and matches. Offsets are
code points, end exclusive. They come from splitting the text by the same pattern: a match starts after
all earlier pieces and matches. Patterns take runs of their characters whole, so a long run isn't tried from each of
its characters; `\G` lets a match begin in a run whose head the last match has used. Repeated groups are possessive, as
Java's matcher takes a stack frame a repetition of others and thousands of them would end the executor.

Nulls and extremes: a null text is empty and has no spans; a null id stays null; texts of any length are read whole;
repeated rows are all returned; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import cut, in_blocks

from .common import let, prefix_sums

NEAR = 48


@dataclass(frozen=True)
class Kind:
    """hint: a pattern without which no match exists, cheap to look for. context: words that raise the score."""

    name: str
    pattern: str
    hint: str
    score: float
    context: str


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(x: Column) -> Column:
    """Remainder of an account number's digits, letters counted from 10, its first four characters moved last."""
    bare = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(n < 10, acc * 10 + n).otherwise(acc * 100 + n) % 97

    return F.aggregate(F.regexp_extract_all(turned, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), step)


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits(x)).between(14, 19) & F.call_function("luhn_check", digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(x) == 1)
    return F.lit(True)


BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|reach"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.7, "card|visa|credit|payment|cc"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "call|phone|tel|mobile|fax"),
)
SECRETS = "token|secret|api|key|password|passwd|pwd|auth|bearer|credential|private"
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|transfer|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social|security|tax"),
    Kind(
        "key",
        r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
        "A[KS]IA|gh[pousr]_|sk-|xox|AIza|eyJ|PRIVATE KEY",
        0.8,
        SECRETS,
    ),
    Kind("secret", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+", "[A-Za-z0-9_+/=-]{20}", 0.3, SECRETS),
    Kind("passport", r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])", "[A-Z][0-9]{6}", 0.3, "passport|reisepass|passeport|pasaporte"),
)

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind in order."""
    pattern = F.lit(kind.pattern)

    def found(matches: Column, blocks: Column) -> Column:
        pieces = F.split(text, kind.pattern, -1)
        steps = F.transform(F.arrays_zip(matches.alias("m"), F.slice(pieces, F.lit(1), F.size(matches)).alias("g")), lambda x: (F.length(x["m"]) + F.length(x["g"])).cast("bigint"))
        both = F.arrays_zip(matches.alias("m"), prefix_sums(steps).alias("e"))
        good = F.filter(both, lambda x: valid(kind.name, x["m"]))

        def span(x: Column) -> Column:
            start = x["e"] - F.length(x["m"])
            around = F.concat_ws("\n", cut(blocks, F.greatest(start - NEAR, F.lit(0)), F.least(start, F.lit(NEAR))), cut(blocks, x["e"], F.lit(NEAR)))
            near = around.rlike(rf"(?i)(?<![A-Za-z])(?:{kind.context})")
            score = F.round(F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, 0.25).otherwise(0.0)), 4)
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

        return F.transform(good, span)

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    some = let(matches, lambda m: F.when(F.size(m) > 0, let(in_blocks(text), lambda blocks: found(m, blocks))).otherwise(F.array().cast(SPAN)))
    return F.when(text.rlike(kind.hint), some).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and, for each kind, its spans (start, rank, end, kind, score) in order."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cols = [spans_of(F.col("text"), k, i).alias(k.name) for i, k in enumerate(BASE)]
    cols += [F.filter(spans_of(F.col("text"), k, len(BASE) + i), lambda s: s["score"] >= threshold).alias(k.name) for i, k in enumerate(ADDED)]
    return base.select("doc_id", "text", *cols)


def digest_of(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores_of(spans: Column) -> Column:
    """The scores of all spans, in the order of digest_of, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: s["score"].cast("string")), ",")


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; of overlapping spans the first, longer one."""
    every = F.concat(*(F.col(k.name) for k in BASE + ADDED))
    order = F.sort_array(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def put(spans: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))

        def step(acc: Column, s: Column) -> Column:
            more = F.struct(F.concat(acc["out"], F.array(F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out"), (-s["back"]).alias("at"))
            return F.when(s["start"] < acc["at"], acc).otherwise(more)

        return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr("text", (acc["at"] + 1).cast("int"))))

    return found.select("doc_id", F.when(F.size(every) > 0, let(order, put)).otherwise(F.col("text")).alias("text"))
