"""Reports out: JSON, Markdown and the library's tables, assembled as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import format_bytes
from inkwell.operators import cite, library, quality, redact


def to_json(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.select(id_col, F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("json"))


def table_markdown(rows: Column) -> Column:
    """A table of arrays of cells, the first row its header, padded to the widest; pipes escaped."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.trim(F.replace(F.regexp_replace(c, r"\s+", " "), F.lit("|"), F.lit("\\|")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.coalesce(F.get(r, i), F.lit("")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.concat_ws("\n", line(rows[0]), rule, F.array_join(F.transform(F.slice(rows, F.lit(2), F.size(rows)), line), "\n"))


def front_matter(fields: dict[str, Column]) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("n/a")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}: "), quoted(c)) for k, c in fields.items()), F.lit("---"))


def read_front_matter(text: Column) -> Column:
    """The fields before the body as a map, quotes taken off."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), '^"|"$', ""))))


def lines(*parts: Column | str | None) -> Column:
    """Lines joined; null ones are left out."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts if p is not None))


def say(*parts: Column | str) -> Column:
    """Parts in one string; null if one of them is null."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def section(title: str, body: Column, when: Column | None = None) -> Column:
    whole = F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n"))
    return whole if when is None else F.when(when, whole)


def block_markdown(b: Column) -> Column:
    """A block by its type; headings one level below the report's own."""
    head = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.coalesce(b["level"] + 1, F.lit(3)))), F.lit(" "), b["text"])
    return (
        F.when(b["type"] == "table", F.concat(table_markdown(b["rows"]), F.lit("\n"))).when(b["type"] == "heading", F.concat(F.lit("\n"), head, F.lit("\n"))).when(b["type"] == "list", F.concat(F.lit("- "), b["text"]))
        .when(b["type"] == "note", F.concat(F.lit("_"), b["text"], F.lit("_\n"))).when(b["type"] == "caption", F.concat(F.lit("**"), b["text"], F.lit("**\n")))
        .otherwise(F.concat(b["text"], F.lit("\n")))
    )


def score_lines(score: Column, parts: dict[str, Column]) -> Column:
    shown = [say("- ", name, ": ", F.coalesce(c.cast("string"), F.lit("n/a"))) for name, c in parts.items()]
    return lines(say("**", score, " / 100** ", F.repeat(F.lit("★"), quality.stars(score))), "", *shown)


def verdict_lines(verdict: Column, issues: Column, notes: Column) -> Column:
    return lines(verdict, F.when(F.size(issues) > 0, F.concat(F.lit("\n**Issues**\n\n"), bullets(issues))), F.when(F.size(notes) > 0, F.concat(F.lit("\n**Notes**\n\n"), bullets(notes))))


def flag_list(flags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(flags, ", "), F.lit("]"))


def document_markdown(reports: DataFrame) -> DataFrame:
    """doc_id, markdown: a whole report; sections 10 to 12 are never produced, and sections without content are left out."""
    c = F.col
    some = lambda name: F.size(name) > 0
    head = front_matter({"title": c("title"), "doc_class": c("doc_class"), "knowledge_score": c("knowledge_score"), "verdict_flags": flag_list(F.split("verdict_flags", " ")), "type": c("source_type"), "pages": c("pages"), "language": c("language")})
    parts = {"structure": c("structure_score"), "content": c("content_score"), "references": c("reference_score"), "tables": F.lit(None)}
    tree = F.transform("sections", lambda x: F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), x["level"] - 1)), F.lit("- "), x["title"]))
    refs = F.transform("references", lambda r: F.concat(F.lit("- "), r["raw"], F.coalesce(F.concat(F.lit(" — DOI: "), r["doi"]), F.lit(""))))
    body = lines(
        say("# ", c("title"), "\n"),
        section("1. Executive Summary", c("summary"), c("summary") != ""),
        section("2. Knowledge Score", score_lines(c("knowledge_score"), parts)),
        section("3. Document Metadata", lines(say("- Type: ", c("source_type")), say("- Size: ", format_bytes(c("size_bytes"))), say("- Pages: ", c("pages")), say("- Words: ", c("word_count")), say("- Language: ", c("language")))),
        section("4. Quality Verdict", verdict_lines(c("verdict"), c("issues"), c("notes"))),
        section("5. Contents", F.array_join(tree, "\n"), some("sections")),
        section("6. Structure", F.array_join(F.transform("sections", lambda x: F.concat(F.lit("### "), x["title"], F.lit(" ("), x["words"], F.lit(" words)"))), "\n"), some("sections")),
        section("7. Key Findings", F.when(some("key_findings"), bullets(c("key_findings"))).otherwise(c("findings_note"))),
        section("8. Key Phrases", F.array_join(F.transform("phrases", lambda p: F.concat(F.lit("- "), p["phrase"], F.lit(" ("), F.round(p["score"], 2), F.lit(")"))), "\n"), some("phrases")),
        section("9. References", F.array_join(refs, "\n"), some("references")),
        section("13. Statistics", lines(say("- Words: ", c("statistics.word_count")), say("- Reading time: ~", c("statistics.reading_time_minutes"), " min"), say("- Flesch reading ease: ", c("statistics.flesch_reading_ease")))),
        section("14. Full Extracted Text", F.array_join(F.transform("blocks", block_markdown), "\n"), some("blocks")),
    )
    return reports.select("doc_id", F.concat_ws("\n\n", head, body).alias("markdown"))


def profile_markdown(profiled: DataFrame) -> DataFrame:
    """One Markdown table of a profile's columns."""
    cells = F.array("column", "type", F.format_number("null_rate", 4), F.col("distinct").cast("string"), F.when(F.col("pii"), F.col("pii_reason")).otherwise(""))
    rows = profiled.agg(F.sort_array(F.collect_list(cells)).alias("r")).select(F.concat(F.array(F.array(*map(F.lit, ("column", "type", "missing", "distinct", "personal data")))), F.col("r")).alias("r"))
    return rows.select(table_markdown(F.col("r")).alias("markdown"))


def dataset_markdown(title: str, profiled: DataFrame, scored: DataFrame, pairs: DataFrame, found: DataFrame, judged: DataFrame, context: bool = False) -> DataFrame:
    """One row, markdown: overview, score, metadata, verdict, findings, columns and correlations of a table. Every part has a
    row a column, or a pair of columns, at most. `context` leaves out the correlations."""
    per_column = profile_markdown(profiled).withColumnRenamed("markdown", "columns")
    shape = profiled.agg(F.max("total").alias("rows"), F.count("*").alias("width"), F.max("pii").alias("pii"))
    said = found.agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "k", "finding"))), lambda x: x["finding"]).alias("findings"))
    cell = F.array("a", "b", F.coalesce(F.format_number("r", 2), F.lit("n/a")))
    matrix = pairs.agg(F.sort_array(F.collect_list(cell)).alias("r")).select(table_markdown(F.concat(F.array(F.array(*map(F.lit, ("a", "b", "r")))), F.col("r"))).alias("matrix"), F.size("r").alias("n_pairs"))
    row = per_column.crossJoin(shape).crossJoin(said).crossJoin(matrix).crossJoin(scored).crossJoin(judged)
    c = F.col
    head = front_matter({"title": F.lit(title), "doc_class": F.lit("dataset"), "knowledge_score": c("score"), "verdict_flags": flag_list(c("flags")), "rows": c("rows"), "columns": c("width")})
    body = lines(
        f"# {title}\n",
        section("1. Overview", say("A table of ", c("rows"), " rows and ", c("width"), " columns.")),
        section("2. Knowledge Score", score_lines(c("score"), {"completeness": c("completeness"), "consistency": c("consistency"), "integrity": c("integrity")})),
        section("3. Dataset Metadata", lines(say("- Rows: ", c("rows")), say("- Columns: ", c("width")), "- Pages: n/a (dataset)")),
        section("4. Quality Verdict", verdict_lines(c("verdict"), c("issues"), c("notes"))),
        section("5. Key Findings", bullets(c("findings")), F.size("findings") > 0),
        section("6. Column Profile", c("columns")),
        None if context else section("7. Correlation Matrix", c("matrix"), c("n_pairs") > 0),
    )
    return row.select(F.concat_ws("\n\n", head, body).alias("markdown"))


def citation_markdown(title: str, passages: DataFrame, matched: DataFrame, evidence: DataFrame, suitability: DataFrame, names: DataFrame) -> DataFrame:
    """One row, markdown: how references suit a working document. names: ref_id, name. The document's passages and their
    matches (three a passage) meet in one row, as its report does."""
    known = matched.join(evidence, ["passage_id", "ref_id"], "left").join(names, "ref_id", "left")
    shown = known.select("passage_id", "rank", "ref_id", "name", "affinity", say("- ", F.coalesce("name", F.col("ref_id").cast("string")), " (", F.col("affinity"), ", ", cite.tier(F.col("affinity")), "): ", F.coalesce("shared", F.lit(""))).alias("line"))
    by_passage = shown.groupBy("passage_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    annotated = passages.join(by_passage, "passage_id", "left").select("passage_id", lines(say("### ", F.coalesce("title", F.col("passage_id").cast("string"))), "", F.col("text"), "", F.coalesce("lines", F.lit("_No reference matches._"))).alias("s"))
    document = annotated.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("passage_id", "s"))), lambda x: x["s"]), "\n\n").alias("document"))
    ranked = suitability.join(names, "ref_id", "left").withColumn("shown", F.coalesce("name", F.col("ref_id").cast("string")))
    table = ranked.agg(F.sort_array(F.collect_list(F.struct((-F.col("suitability")).alias("o"), "ref_id", F.array("shown", say(F.col("suitability"), "%"), F.col("coverage").cast("string")).alias("cells")))).alias("r"))
    table = table.select(table_markdown(F.concat(F.array(F.array(*map(F.lit, ("reference", "suitability", "passages")))), F.transform("r", lambda x: x["cells"]))).alias("summary"))
    per_ref = shown.groupBy("ref_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("passage_id", "affinity"))), lambda x: F.concat(F.lit("- passage "), x["passage_id"], F.lit(": "), x["affinity"])), "\n").alias("hits"))
    proof = ranked.join(per_ref, "ref_id").select((-F.col("suitability")).alias("o"), "ref_id", lines(say("### ", F.col("shown"), " — ", F.col("suitability"), "%"), "", F.col("hits")).alias("s"))
    proof = proof.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "ref_id", "s"))), lambda x: x["s"]), "\n\n").alias("evidence"))
    body = lines(f"# {title}\n", section("1. Suitability Summary", F.col("summary")), section("2. Annotated Document", F.col("document")), section("3. Per-Reference Evidence", F.col("evidence")))
    return table.crossJoin(document).crossJoin(proof).select(body.alias("markdown"))


def redaction_markdown(redacted: DataFrame, found: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown: counts by category, the redacted fields in order and, if asked for, the map from tokens back.

    A document that still holds a surface is refused: its markdown is null. redacted: doc_id, text and, if there is one, field.
    """
    left = redact.leaks(redacted, found).select("doc_id", "leaks")
    fields = redact.with_field(redacted).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("field", "text"))), lambda x: x["text"]), "\n\n").alias("text")).join(left, "doc_id")
    counts = redact.spans(found).groupBy("doc_id", "category").agg(F.count("*").alias("n"))
    rows = counts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.array("category", F.col("n").cast("string")))).alias("r"), F.sum("n").alias("all"))
    table = table_markdown(F.concat(F.array(F.array(F.lit("category"), F.lit("redacted"))), F.col("r")))
    out = fields.join(rows, "doc_id", "left")
    if tokens is not None:
        pairs = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.array("token", "surface"))).alias("map"))
        out = out.join(pairs, "doc_id", "left")
    back = None if tokens is None else section("Re-identification map", table_markdown(F.concat(F.array(F.array(F.lit("token"), F.lit("surface"))), F.col("map"))), F.size("map") > 0)
    summary = lines(say(F.coalesce("all", F.lit(0)), " span(s) redacted."), F.when(F.size("r") > 0, F.concat(F.lit("\n"), table)))
    whole = lines(section("Redaction summary", summary), section("Document (redacted)", F.col("text")), back)
    return out.select("doc_id", F.when(F.col("leaks") == 0, whole).alias("markdown"))


def compilation_markdown(title: str, chosen: DataFrame, phrases: DataFrame, refs: DataFrame, context: bool = False) -> DataFrame:
    """One row, markdown: reports one after another under their own numbers, and their phrases and references together.

    chosen: ord, doc_id, title, markdown. `context` keeps verdicts and full texts only. A compilation is as large as the
    reports that a user picked for it.
    """
    parts = library.sections(chosen.select("doc_id", F.col("markdown").alias("text")))
    if context:
        parts = parts.where(F.col("title").rlike("(?i)Quality Verdict|Full Extracted Text"))
    whole = parts.join(chosen.select("doc_id", (F.col("ord") + 1).alias("i"), F.col("title").alias("name")), "doc_id")
    one = whole.select("i", "name", "section", F.concat(F.lit("## "), library.renumber(F.col("title"), F.col("i")), F.lit("\n"), F.col("body")).alias("s"))
    docs = one.groupBy("i", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "s"))), lambda x: x["s"]), "\n\n").alias("s"))
    text = docs.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name", "s"))), lambda x: F.concat(F.lit("# Document "), x["i"], F.lit(" — "), x["name"], F.lit("\n\n"), x["s"])), "\n\n").alias("text"))
    listed = chosen.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda x: F.concat((x["ord"] + 1).cast("string"), F.lit(". "), x["title"])), "\n").alias("listed"))
    words = phrases.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "phrase"))), lambda x: x["phrase"]).alias("words"))
    cited = refs.agg(F.sort_array(F.collect_set("raw")).alias("cited"))
    row = text.crossJoin(listed).crossJoin(words).crossJoin(cited)
    body = lines(
        f"# {title}\n",
        section("Constituent Documents", F.col("listed")),
        section("Combined Key Phrases", bullets(F.col("words")), F.size("words") > 0),
        section("Combined References", bullets(F.col("cited")), F.size("cited") > 0),
        F.col("text"),
    )
    return row.select(body.alias("markdown"))


def delete_reports(path: str, ids: DataFrame, out: str) -> None:
    """The library's tables without some reports (ids: report_id), written as a new library: children go with their report."""
    spark = ids.sparkSession
    for name, key in (("reports", "id"), ("keyphrases", "report_id"), ("references", "report_id")):
        rows = spark.read.parquet(f"{path}/{name}")
        rows.join(ids.select(F.col("report_id").alias(key)), key, "left_anti").select(*rows.columns).write.parquet(f"{out}/{name}")


def write_library(reports: DataFrame, phrases: DataFrame, references: DataFrame, path: str) -> None:
    """Three tables: reports, their key phrases (128 characters at most, none empty) and references."""
    reports.write.mode("append").parquet(f"{path}/reports")
    phrases.where("trim(phrase) <> ''").withColumn("phrase", F.left("phrase", F.lit(128))).write.mode("append").parquet(f"{path}/keyphrases")
    references.write.mode("append").parquet(f"{path}/references")
