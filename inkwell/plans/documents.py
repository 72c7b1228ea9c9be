"""Document reports: blocks to structure, statistics, references, phrases, summary, checks and score, one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import held, let, trim, word_count
from inkwell.operators import blocks, normalise, quality, references, stats, summary

#: Share of list blocks, with two headings or more, from which a summary is a template of the headings.
LIST_SHARE = 0.5


def sections_of(found: Column) -> Column:
    """The sections (title, level, words) of a document's blocks: a heading opens one; text before the first has none."""
    at = F.filter(F.transform(found, lambda x, i: F.when(x["type"] == "heading", i)), lambda i: i.isNotNull())

    def whole(heads: Column) -> Column:
        def section(p: Column, i: Column) -> Column:
            end = F.coalesce(F.get(heads, i + 1), F.size(found))
            body = F.filter(F.slice(found, p + 2, end - p - 1), lambda x: x["type"].isin("paragraph", "list", "table"))
            words = F.aggregate(body, F.lit(0).cast("bigint"), lambda n, x: n + word_count(x["text"]))
            head = F.get(found, p)
            return F.struct(head["text"].alias("title"), F.coalesce(head["level"], F.lit(2)).alias("level"), words.alias("words"))

        return F.transform(heads, section)

    return F.get(F.transform(F.array(at), whole), F.lit(0))


def doc_class(by_template: Column, tables: Column) -> Column:
    return F.when(by_template, "list-dominant").when(tables > 0, "form").otherwise("prose")


def findings_of(found: Column, by_template: Column, ranked: Column, furniture: Column) -> Column:
    """A document's key findings: from its ranked sentences, or, where the summary is a template, from lists and paragraphs."""
    bodies = F.filter(found, lambda x: x["type"].isin("list", "paragraph", "table"))
    #: Every cell of a table stands for itself.
    texts = F.flatten(F.transform(bodies, lambda x: F.when(x["type"] == "table", normalise.cells_of(x["rows"])).otherwise(F.array(x["text"]))))
    once = lambda xs: let(summary.repeated(xs), lambda again: F.filter(xs, lambda _, i: ~F.coalesce(F.get(again, i), F.lit(False))))
    listed = let(F.flatten(F.transform(texts, summary.sentences_of)), once)
    genuine = F.filter(F.when(by_template, listed).otherwise(ranked), lambda s: summary.is_genuine(s, furniture))
    return let(genuine, lambda s: F.when(F.size(s) > 0, summary.densest(s)).otherwise(s))


def document_reports(docs: DataFrame, stem: Column | None = None, meta_title: Column | None = None) -> DataFrame:
    """One row a document: title, blocks, statistics, references, phrases, summaries, checks, notes, scores and flags.

    docs: doc_id, text, what `stem` (a name without suffix) and `meta_title` refer to and, from files, kind, source_blocks and
    pages. A row has its whole document, so nothing is shuffled; what needs neighbours or a document's words goes through
    tasks twice, first its lines, then its text and sentences.
    """
    named = docs.withColumns({"_stem": F.concat(F.lit("document-"), F.col("doc_id")) if stem is None else stem, "_meta_title": F.lit(None).cast("string") if meta_title is None else meta_title, "_pages": F.col("pages") if "pages" in docs.columns else F.lit(None).cast("int")})
    strip = lambda x: F.regexp_replace(x, blocks.NUMBER, "")
    prose = F.concat(F.col("removed"), F.transform(F.filter("blocks", lambda x: x["table_row"]), lambda x: x["text"]))
    prepared = normalise.prepare(named, "_stem", "_meta_title", "_pages").withColumnsRenamed({"_stem": "stem", "_meta_title": "meta_title", "_pages": "pages"})
    sentences = let(summary.sentences_of(F.col("text")), lambda s: F.struct(s.alias("all"), summary.repeated(s).alias("again")))
    ready = held(prepared.withColumn("text", stats.valid(F.col("text"))).withColumns({
        "titles": F.transform(F.filter("blocks", lambda x: x["type"] == "heading"), lambda x: strip(x["text"])),
        "furniture": F.array_distinct(F.filter(F.transform(prose, summary.normal), lambda x: F.length(x) >= 8)),
        "sentences": sentences,
    }))
    ready = ready.withColumn("by_template", (F.col("list_ratio") >= LIST_SHARE) & (F.size("titles") >= 2))
    scored = ready.withColumns({"places": summary.ranked_or_lead_places("sentences.all", "sentences.again"), "phrases": stats.rake_of(F.col("text")), "counts": stats.counts_of(stats.valid(F.col("text")))})
    ranked = F.transform("places", lambda i: F.get("sentences.all", i))
    chosen = let(ranked, lambda r: F.struct(r.alias("ranked"), findings_of(F.col("blocks"), F.col("by_template"), r, F.col("furniture")).alias("key_findings")))
    return judged(held(scored.withColumn("chosen", chosen).drop("sentences", "places", "furniture")).select("*", "chosen.*"))


def judged(whole: DataFrame) -> DataFrame:
    """Reports from prepared documents with their counts, sentences, phrases and findings: projections only."""
    c = F.col
    first_heading = F.get(F.transform(F.filter("blocks", lambda x: (x["type"] == "heading") & (F.octet_length(x["text"]) > 3)), lambda x: x["text"]), F.lit(0))
    title_like = lambda x: F.when(blocks.looks_like_title(trim(x)), trim(x))
    words = c("counts.w")
    facts = whole.select(
        "doc_id", "source_type", "text", "blocks", "list_ratio", "removed", "by_template", "titles", "size_bytes", blocks.pages_shown(c("source_type"), F.coalesce("pages", F.lit(1))).alias("pages"),
        F.left(F.coalesce(title_like(c("meta_title")), title_like(c("header")), first_heading, c("stem")), F.lit(255)).alias("title"),
        words.alias("words"),
        stats.readability(c("text"), c("counts")).alias("statistics"),
        stats.language_by(words, c("counts.l")).alias("language"),
        references.listed(c("text")).alias("references"),
        "phrases", "ranked", "key_findings",
        sections_of(c("blocks")).alias("sections"),
        F.regexp_count("text", F.lit(quality.MOJIBAKE)).alias("mojibake"),
        quality.fragments(c("text")).alias("fragments"),
        F.length(trim(c("text"))).alias("text_chars"),
        F.aggregate("blocks", F.lit(0), lambda n, x: n + F.when(x["type"] == "heading", F.length(x["text"])).otherwise(0)).alias("heading_chars"),
    )
    body = F.concat_ws(" ", F.nullif(summary.lead_sentence(c("blocks")), F.lit("")), summary.template_body(c("titles")))
    facts = facts.withColumns({
        "summary": F.when(c("by_template"), summary.first_words(body, 150)).otherwise(summary.joined_words(c("ranked"), 5, 150)),
        "extended": F.when(c("by_template"), summary.first_words(body, 500)).otherwise(summary.joined_words(c("ranked"), 8, 500)),
        "findings_note": F.when(F.size("key_findings") > 0, "").when(c("by_template"), "No quantitative or conclusive findings detected (list-type document).").otherwise("No quantitative or conclusive findings detected."),
        "n_blocks": F.size("blocks"), "n_sections": F.size("sections"), "empty_sections": F.size(F.filter("sections", lambda x: x["words"] == 0)),
        "top_share": F.coalesce(F.try_divide(F.array_max(F.transform("sections", lambda x: x["words"])), F.aggregate("sections", F.lit(0).cast("bigint"), lambda n, x: n + x["words"])), F.lit(0.0)),
        "n_references": F.size("references"), "n_phrases": F.size("phrases"),
        "glyph_phrases": F.size(F.filter("phrases", lambda p: quality.holds_glyph(p["phrase"]))),
        "n_tables": F.size(F.filter("blocks", lambda x: x["type"] == "table")),
        "n_flattened": F.size(F.filter("blocks", lambda x: (x["type"] == "note") & (x["text"] == normalise.TABLE_NOTE))),
        "n_formulas": F.size(F.filter("blocks", lambda x: x["math_degraded"])),
    })
    checked = quality.checks(facts).withColumns({
        "structure_score": quality.structure_score(c("n_blocks"), c("n_sections"), c("top_share")),
        "reference_score": quality.reference_score(c("n_references")),
    })
    checked = checked.withColumn("content_score", quality.content_score(F.octet_length("summary"), c("n_phrases"), c("words"), F.coalesce("content_loss", F.lit(False))))
    scored = checked.withColumns({
        "knowledge_score": quality.composite(c("structure_score"), c("content_score"), c("reference_score")),
        "issues": quality.issues(), "flags": quality.flags(), "notes": quality.notes(),
        "doc_class": doc_class(c("by_template"), c("n_tables")),
    })
    return scored.select(
        "doc_id", "title", "doc_class", "source_type", "pages", "n_tables", "size_bytes", c("words").alias("word_count"), "language", (c("language") == "und").alias("language_fallback"), "statistics",
        "sections", "n_sections", "n_references", "n_phrases", "list_ratio", "summary", "extended", "key_findings", "findings_note", "phrases", "references", "titles", "blocks", "removed",
        "structure_score", "content_score", "reference_score", "knowledge_score", quality.stars(c("knowledge_score")).alias("stars"), quality.band(c("knowledge_score")).alias("band"),
        "issues", "notes", quality.verdict_text(F.size("issues"), F.size("notes")).alias("verdict"), F.array_join("flags", " ").alias("verdict_flags"),
    )


def file_reports(files: DataFrame) -> DataFrame:
    """path and the report of each file that read_documents gave, under a number hashed from its path."""
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)
    docs = files.withColumn("doc_id", F.xxhash64("path"))
    return docs.select("doc_id", "path").join(document_reports(docs, name, F.col("meta_title")), "doc_id")
