"""Verdicts and the knowledge score of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# List glyphs, mojibake pairs, split endings and the stems that don't count, words a kilobyte by type.
GLYPHS = r"[\x{2022}\x{2023}\x{25AA}\x{25CF}\x{25E6}\x{2043}\x{2219}\x{00B7}\x{2713}\x{2714}\x{2717}\x{2718}\x{2610}\x{2611}\x{2612}\x{2700}-\x{27BF}\x{E000}-\x{F8FF}]"
MOJIBAKE = r"[\x{00C2}-\x{00F4}][\x{0080}-\x{00BF}\x{20AC}\x{2122}\x{2018}\x{2019}\x{201C}\x{201D}\x{2013}\x{2014}\x{2026}]"
ENDINGS = "se|ses|sing|sation|isation|ization|tion|sion|sions|ity|ities|ment|ments|ised|ized|ising|izing"
STEMS = "the and for are was her his she you our out not can has had but all any one two its who why how may per use new".split()
FLOOR = {"DOCX": 10.0, "PDF": 2.0, "TXT": 20.0, "MD": 20.0}


def holds_glyph(x: Column) -> Column:
    """Whether a text has a list glyph; few texts have a character of their ranges at all."""
    return x.rlike(r"[\x{00B7}\x{2022}-\x{F8FF}]") & x.rlike(GLYPHS)


def fragments(text: Column) -> Column:
    """Words that extraction has split before their ending, each once, in order."""
    #: Few texts hold an ending as a word of its own, and only these are looked through word by word.
    hint = text.rlike(rf" (?:{ENDINGS})(?![\p{{L}}\p{{N}}_])")
    found = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(\p{{Ll}}{{3,}} (?:{ENDINGS}))(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    return F.when(hint, F.array_distinct(F.filter(found, lambda x: ~F.split(x, " ")[0].isin(*STEMS)))).when(text.isNotNull(), F.array().cast("array<string>"))


def split_artefacts(docs: DataFrame) -> DataFrame:
    """doc_id, fragment: one row a split word of a document."""
    return docs.select("doc_id", F.explode(fragments(F.col("text"))).alias("fragment"))


def checks(facts: DataFrame) -> DataFrame:
    """Booleans of the checks, from facts about each document.

    facts: doc_id, n_blocks, n_sections, empty_sections, words, size_bytes, heading_chars, text_chars, mojibake, summary,
    glyph_phrases, source_type.
    """
    floors = F.create_map(*(F.lit(x) for kv in FLOOR.items() for x in kv))
    facts = facts.withColumns({
        "empty_body": (F.col("n_sections") >= 3) & (F.col("empty_sections") >= 0.9 * F.col("n_sections")),
        "thin": (F.col("size_bytes") > 4096) & (F.col("words") / (F.col("size_bytes") / 1024) < floors[F.col("source_type")]),
        "all_headings": F.coalesce(F.try_divide("heading_chars", "text_chars") >= 0.8, F.lit(False)),
    })
    return facts.withColumns({
        "no_content": F.col("n_blocks") == 0,
        "no_summary": F.trim("summary") == "",
        "short_document": (F.col("words") > 0) & (F.col("words") < 50),
        "content_loss": F.col("empty_body") | F.col("thin") | F.col("all_headings"),
        "contamination": (F.col("glyph_phrases") > 0) | holds_glyph(F.col("summary")),
        "mojibake_found": F.col("mojibake") >= 3,
    })


ISSUES = ("no_content", "no_summary", "short_document", "content_loss", "contamination", "mojibake_found")


def flags() -> Column:
    """Names of the checks that failed, and of what the source itself has wrong, in order."""
    found = [F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c.removesuffix("_found"))) for c in ISSUES]
    found += [F.when(F.size("fragments") > 0, "source_artefacts"), F.when(F.col("n_formulas") > 0, "equation_degraded")]
    return F.array_compact(F.array(*found))


def issues() -> Column:
    """What is wrong with an extraction, in words; from the columns of checks."""
    c = F.col
    say = lambda when, *parts: F.when(F.coalesce(when, F.lit(False)), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    kb = c("size_bytes") / 1024
    return F.array_compact(F.array(
        say(c("no_content"), "No readable content blocks were found."),
        say(c("no_summary"), "No summary could be made; the extract may be too short."),
        say(c("short_document"), "The document is very short (", c("words").cast("string"), " words), so the analysis is less certain."),
        say(c("empty_body"), c("empty_sections").cast("string"), " of ", c("n_sections").cast("string"), " sections have no body content; the body may not have been read."),
        say(c("thin"), "Only ", c("words").cast("string"), " words were recovered from ", F.round(kb).cast("bigint").cast("string"), " KB (", F.round(c("words") / kb, 1).cast("string"), " words a KB)."),
        say(c("all_headings"), "The text is almost only section headings."),
        say(c("contamination"), "List glyphs reached the key phrases or the summary."),
        say(c("mojibake_found"), "Broken character encodings remain in the text."),
    ))


def notes() -> Column:
    """What a reader should know about an extraction that went well: furniture, what wasn't analysed, tables, formulas,
    split words, numbering."""
    c = F.col
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    quoted = lambda a, n: text('"', F.array_join(F.slice(a, 1, n), '", "'), '"')
    once = F.array_distinct("removed")
    missing = F.array_compact(F.array(F.lit("Entities"), F.lit("Figures"), F.when(c("n_tables") + c("n_flattened") == 0, "Tables (none detected)"), F.when(c("n_references") == 0, "References (none detected)")))
    return F.array_compact(F.array(
        F.when(F.size("removed") > 0, text(F.size("removed").cast("string"), " line(s) of page furniture were removed: ", quoted(once, 6), F.when(F.size(once) > 6, " …").otherwise(""), ".")),
        text("Not analysed: ", F.array_join(missing, ", "), ". These don't count in the score."),
        F.when(c("n_tables") > 0, text(c("n_tables").cast("string"), " table(s) kept with rows and columns.")),
        F.when(c("n_flattened") > 0, text(c("n_flattened").cast("string"), " table region(s) lost their cells; rows stand as lines.")),
        F.when(c("n_formulas") > 0, text(c("n_formulas").cast("string"), " region(s) of formulas may have lost symbols.")),
        F.when(F.size("fragments") > 0, text(F.size("fragments").cast("string"), " word(s) are split in the source, such as ", quoted(c("fragments"), 3), ".")),
        F.lit("Section numbers are fixed; sections without content are left out, not renumbered."),
    ))


def verdict_text(n_issues: Column, n_notes: Column) -> Column:
    some = F.concat(F.lit(" and "), n_notes, F.lit(" note(s)"))
    return F.when(n_issues > 0, F.concat(F.lit("Extracted with "), n_issues, F.lit(" issue(s)"), F.when(n_notes > 0, some).otherwise(""), F.lit("."))).when(n_notes > 0, F.concat(F.lit("Extracted without issues; "), n_notes, F.lit(" note(s)."))).otherwise("Extracted without issues.")


def structure_score(blocks: Column, sections: Column, top_share: Column) -> Column:
    base = F.least(F.lit(98), 50 + 8 * sections + F.least(F.lit(20), F.floor(blocks / 5)))
    return F.when(blocks == 0, 30).when((sections >= 4) & (top_share >= 0.7), F.least(base, F.lit(55))).otherwise(base).cast("int")


def content_score(summary_bytes: Column, phrases: Column, words: Column, loss: Column) -> Column:
    full = 60 + F.when(summary_bytes > 50, 15).otherwise(0) + F.when(phrases >= 5, 15).otherwise(0)
    return F.when(loss | (words < 50), F.least(full, F.lit(25))).otherwise(F.least(full, F.lit(98))).cast("int")


def reference_score(n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(98), 70 + F.least(F.lit(28), 2 * n))).cast("int")


def composite(structure: Column, content: Column, references: Column) -> Column:
    """Weighted mean of the dimensions present (tables never are); weak content caps it."""
    parts = ((structure, 0.25), (content, 0.35), (references, 0.20))
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    mean = F.round(total / weight).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(content < 40, F.least(mean, F.greatest(F.lit(30), content))).otherwise(mean)))


def stars(score: Column) -> Column:
    return F.when(score >= 95, 5).when(score >= 85, 4).when(score >= 70, 3).when(score >= 50, 2).otherwise(1)


def band(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 70, "good").when(score >= 50, "fair").otherwise("low")
