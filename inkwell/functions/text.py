"""Text scalars: trimming, counting and cleaning as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What trimming removes (fixed value): space, tab, line feed, carriage return, NUL, vertical tab.
BLANKS = " \t\n\r\0\x0b"

#: Values that mean "no value" in a data cell, trimmed and lower-cased (fixed values).
NULL_TOKENS = ("", "na", "n/a", "null", "nan", "none", "-", "#n/a")

NUMERIC = r"^[ \t\n\r\x0b\x0c]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0b\x0c]*$"
LINE_BREAK = r"\r\n|\r|\n"


def split_lines(x: Column) -> Column:
    """The lines of a text; most texts have line feeds only, which need no pattern."""
    return F.when(x.contains("\r"), F.split(x, LINE_BREAK, -1)).otherwise(F.split(x, "\n", -1))


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def _accents() -> tuple[str, str]:
    """Latin letters that are an ASCII letter with marks, in lower case, and these letters; then the marks themselves."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))]
    known = {c: d[0] for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].islower()}
    return "".join(known) + "".join(map(chr, range(0x300, 0x370))), "".join(known.values())


ACCENTS = _accents()


def fold(x: Column) -> Column:
    """Without case, and Latin letters without accents."""
    return F.translate(F.lower(x), *ACCENTS)


def terms_of(query: str) -> list[str]:
    """The words of a query, folded as `fold` does."""
    plain = query.lower().translate(str.maketrans(dict(zip(ACCENTS[0], ACCENTS[1].ljust(len(ACCENTS[0]), "\0"), strict=True)))).replace("\0", "")
    return [w for w in re.split(r"[^\w]+", plain) if w]


def is_missing(x: Column) -> Column:
    return F.coalesce(F.lower(trim(x)).isin(*NULL_TOKENS), F.lit(True))


def is_numeric(x: Column) -> Column:
    return x.rlike(NUMERIC)


def word_count(x: Column) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens; apostrophes and hyphens at the text's ends don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"^['-]+", ""), r"-+$", "")
    return F.regexp_count(bare, F.lit("[A-Za-z'-]+")).cast("bigint")


def sentence_count(x: Column) -> Column:
    """Runs of end marks, a line break counting as one, at least one."""
    flat = F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n|\n|\r|\x0b|\x0c|\x{85}|\x{2028}|\x{2029}", ". ")
    closed = F.when(trim(flat).rlike(r"[.!?]$"), flat).otherwise(F.concat(flat, F.lit(".")))
    return F.greatest(F.lit(1), F.regexp_count(closed, F.lit("[.!?]+"))).cast("bigint")


def syllable_count(x: Column) -> Column:
    """Vowel groups, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(F.coalesce(x, F.lit(""))), F.lit("[aeiouy]+"))).cast("bigint")


def collapse(x: Column) -> Column:
    return trim(F.regexp_replace(x, r"\s+", " "))


def format_bytes(n: Column) -> Column:
    mb, kb = n / 1048576.0, n / 1024.0
    return F.when(n >= 1048576, F.concat(F.format_number(mb, 1), F.lit(" MB"))).when(n >= 1024, F.concat(F.round(kb).cast("bigint").cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def clip(x: Column, width: int) -> Column:
    return F.left(x, F.lit(width))


def first_words(x: Column, limit: int) -> Column:
    """At most `limit` words, with an ellipsis if cut."""
    parts = F.split(trim(x), r"\s+")
    return F.when(F.size(parts) > limit, F.concat(F.array_join(F.slice(parts, 1, limit), " "), F.lit("…"))).otherwise(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even if lambdas in the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held(df: DataFrame) -> DataFrame:
    """The table with its columns computed once a row; else Spark may put them into each of their uses. An inner explode would
    make it look for empty arrays first, by computing them twice."""
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_held")).select("_held.*")


def running(values: Column, total: Callable[[Column], Column], both: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For each place of an array the total of what stands before it; by blocks, so that long arrays stay cheap."""

    def blocks(a: Column) -> Column:
        last = F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(a, b * block + 1, block)))

    def run(a: Column, sums: Column) -> Column:
        before = F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))
        return let(before, lambda w: F.transform(a, lambda _, i: both(F.get(w, F.floor(i / block).cast("int")), total(F.slice(a, i - i % block + 1, i % block)))))

    return let(values, lambda a: let(blocks(a), lambda sums: run(a, sums)))


def running_sums(values: Column) -> Column:
    """What stands before each place of an array of longs, summed up."""
    return running(values, lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x), lambda x, y: x + y)


def runs(items: Column, start: Callable[[Column], Column], end: Callable[[Column], Column]) -> Column:
    """Items sorted by start as an array of runs: one that starts after all before it have ended opens a new run."""

    def cut_up(xs: Column, reach: Column) -> Column:
        opens = F.filter(F.transform(xs, lambda x, i: F.when(start(x) >= F.get(reach, i), i)), lambda i: i.isNotNull())
        return let(opens, lambda at: F.transform(at, lambda o, j: F.slice(xs, o + 1, F.coalesce(F.get(at, j + 1), F.size(xs)) - o)))

    reach = lambda xs: running(F.transform(xs, lambda x: end(x).cast("bigint")), lambda part: F.coalesce(F.array_max(part), F.lit(0).cast("bigint")), F.greatest)
    return let(items, lambda xs: let(reach(xs), lambda r: cut_up(xs, r)))


#: Characters of a block of a text that is cut in many places.
BLOCK = 256


def in_blocks(text: Column) -> Column:
    """A text as blocks of equal length, from which `cut` takes parts without walking through the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """Characters of a text in blocks, from start (from 0); fewer at the text's end."""
    first, rest = F.floor(start / BLOCK).cast("int"), (start % BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((rest + length) / BLOCK).cast("int") + 1)
    return F.when(length > 0, F.substr(F.array_join(some, ""), rest + 1, length.cast("int"))).otherwise("")
