"""Documents to blocks: parser choice, Markdown and plain text, line rules, sections, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import LINE_BREAK, collapse, trim, word_count

# Line patterns. Repeated groups are possessive, as Java's matcher takes a stack frame for each repetition of others.
BULLET = r"^\s*(?:[\x{2022}\x{2023}\x{25AA}\x{25CF}\x{25E6}\x{2043}\x{2219}\x{00B7}\x{2713}\x{2714}\x{2717}\x{2718}\x{2610}\x{2611}\x{2612}\x{2700}-\x{27BF}\x{E000}-\x{F8FF}]\s*|[*\x{2013}\x{2014}-]\s+)"
CAPTION = r"(?i)^(fig(?:ure)?\.?|table)\s+\d+[a-z]?\s*[.:\x{2014}\x{2013}\-]\s*\S"
NUMBERED = r"^\s*\d+\.\s+[A-Z]"
SECTION = r"^\s*\d+\.\d+(?:\.\d+)*+\s+\S"
NUMBER = r"^\s*\d+(?:\.\d+)*+\.?\s*"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
PAGE_LABEL = r"(?i)^\s*\d{0,4}\s*\|?\s*p\s*a\s*g\s*e\b"
LEADER = r"\.(\s?\.){3}"
MATH = r"[\x{0370}-\x{03FF}\x{2070}-\x{209F}\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{00B1}\x{00D7}\x{00F7}\x{221A}\x{2211}\x{220F}\x{222B}\x{2260}\x{2264}\x{2265}\x{2248}\x{2208}\x{2207}\x{2202}\x{221E}=]"

HEAD = 8192


def parser_expr() -> Column:
    """Markdown if a `#` stands in the first 8192 bytes, else plain text."""
    head = F.substring(F.encode("text", "UTF-8"), 1, HEAD)
    return F.when(F.instr(F.decode(head, "ISO-8859-1"), "#") > 0, "markdown").otherwise("text")


def parser_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", parser_expr().alias("parser"))


def lines_of(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, columns to carry, pos from 0, line (trimmed)."""
    return docs.select("doc_id", *carry, F.posexplode(F.split("text", LINE_BREAK, -1)).alias("pos", "line")).withColumn("line", trim(F.col("line")))


def markdown_block(line: Column) -> Column:
    heading, bullet = line.rlike(r"^#{1,6}\s+."), line.rlike(r"^[-*]\s+")
    return F.struct(
        F.when(heading, "heading").otherwise("paragraph").alias("type"),
        F.when(heading, F.length(F.regexp_extract(line, r"^(#{1,6})", 1))).alias("level"),
        F.when(heading, F.regexp_extract(line, r"^#{1,6}\s+(.+)", 1)).when(bullet, F.regexp_replace(line, r"^[-*]\s+", "")).otherwise(line).alias("text"),
    )


def text_block(line: Column) -> Column:
    """`#` headings (their level counts the spaces after the marks); short lines in capitals are headings."""
    marked = line.rlike(r"^#{1,6}\s+")
    ascii_upper = F.translate(line, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    capital = (F.octet_length(line) < 80) & ~line.rlike(r"[.!?]$") & (ascii_upper == line)
    rest = F.regexp_replace(line, "^#+", "")
    return F.struct(
        F.when(marked | capital, "heading").otherwise("paragraph").alias("type"),
        F.when(marked, F.length(rest) - F.length(F.ltrim(rest))).when(capital, 2).alias("level"),
        F.when(marked, F.regexp_replace(line, r"^#+\s+", "")).otherwise(line).alias("text"),
    )


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, type, level, text: one block a non-blank line."""
    return lines_of(docs).where("line <> ''").select("doc_id", "pos", markdown_block(F.col("line")).alias("b")).select("doc_id", "pos", "b.*")


def text_blocks(docs: DataFrame) -> DataFrame:
    return lines_of(docs).where("line <> ''").select("doc_id", "pos", text_block(F.col("line")).alias("b")).select("doc_id", "pos", "b.*")


def parse(docs: DataFrame) -> DataFrame:
    """Blocks of each document by its parser, in one projection."""
    rows = lines_of(docs.select("doc_id", "text", parser_expr().alias("parser")), "parser").where("line <> ''")
    block = F.when(F.col("parser") == "markdown", markdown_block(F.col("line"))).otherwise(text_block(F.col("line")))
    return rows.select("doc_id", "pos", block.alias("b")).select("doc_id", "pos", "b.*")


def paragraph_blocks(text: Column) -> Column:
    """Blocks of extracted text (a PDF's, or one recognised elsewhere): paragraphs between blank lines; a paragraph of under
    100 bytes without an end mark is a heading of level 2."""
    parts = F.filter(F.transform(F.split(trim(F.coalesce(text, F.lit(""))), r"\n\s*\n"), trim), lambda x: x != "")

    def block(x: Column, i: Column) -> Column:
        head = (F.octet_length(x) < 100) & ~x.rlike(r"[.!?]$")
        return F.struct(i.alias("pos"), F.when(head, "heading").otherwise("paragraph").alias("type"), x.alias("text"), F.when(head, 2).alias("level"))

    return F.transform(parts, block)


# -- line rules of the normaliser ---------------------------------------------------------------------------------


def signature(line: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(line, r"\d+", "")))


def line_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, sig, n: how often each numberless line occurs in its document."""
    return lines_of(docs).withColumn("sig", signature(F.col("line"))).where("sig <> ''").groupBy("doc_id", "sig").agg(F.count("*").alias("n"))


def page_markers(docs: DataFrame) -> DataFrame:
    """doc_id, pos, kind: page labels, or, where a document has none, lone page numbers beside a blank line or an edge."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    whole = Window.partitionBy("doc_id")
    rows = lines_of(docs).withColumns({
        "label": F.col("line").rlike(PAGE_LABEL),
        "number": F.col("line").rlike(PAGE_NUMBER),
        "alone": (F.coalesce(F.lag("line").over(w), F.lit("")) == "") | (F.coalesce(F.lead("line").over(w), F.lit("")) == ""),
    })
    rows = rows.withColumn("labelled", F.max("label").over(whole))
    kind = F.when(F.col("label"), "label").when(~F.col("labelled") & F.col("number") & F.col("alone"), "number")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("doc_id", "pos", "kind")


def decimal_skeleton(docs: DataFrame) -> DataFrame:
    """doc_id, skeleton: whether two or more short lines carry decimal section numbers."""
    hit = F.col("line").rlike(SECTION) & (F.length("line") < 150)
    return lines_of(docs).groupBy("doc_id").agg((F.count_if(hit) >= 2).alias("skeleton"))


def is_table_header(line: Column) -> Column:
    tokens = F.split(line, r"\s+")
    caps = F.size(F.filter(tokens, lambda t: t.rlike(r"^[(\[]?\p{Lu}")))
    shape = (line != "") & (F.length(line) <= 70) & ~line.rlike(r"[.!?:;,]$")
    for p in (BULLET, NUMBERED, SECTION, LEADER):
        shape = shape & ~line.rlike(p)
    return shape & F.size(tokens).between(3, 8) & (caps >= 3) & (caps >= F.size(tokens) - 1)


def is_table_row(line: Column) -> Column:
    tokens = F.split(line, r"\s+")
    shape = (line != "") & (F.length(line) <= 120) & ~line.rlike(BULLET) & ~line.rlike(SECTION) & ~line.rlike(LEADER)
    return shape & (F.size(tokens) >= 3) & (tokens[0].rlike(r"^\d{1,3}$") | tokens[0].rlike(r"^\p{Lu}{2,5}$"))


def table_regions(docs: DataFrame) -> DataFrame:
    """doc_id, start, rows: a header line, then, blank lines skipped, a run of row lines."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines_of(docs).select("doc_id", "pos", "line", is_table_row(F.col("line")).alias("row"), is_table_header(F.col("line")).alias("header"))
    filled = rows.withColumn("nth", F.row_number().over(order)).withColumn("island", F.sum((~F.col("row")).cast("int")).over(order))
    runs = filled.where("row").groupBy("doc_id", "island").agg(F.min("pos").alias("first"), F.count("*").alias("rows"))
    text = rows.where("line <> ''").withColumns({"before": F.lag("pos").over(order), "header_before": F.lag("header").over(order)}).select("doc_id", F.col("pos").alias("first"), "before", "header_before")
    return runs.join(text.where("header_before"), ["doc_id", "first"]).select("doc_id", F.col("before").alias("start"), "rows")


def is_math_dense(text: Column) -> Column:
    signals = F.regexp_count(text, F.lit(MATH))
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.length(text).between(3, 600) & (signals >= 5) & (signals / F.greatest(F.lit(1), solid) >= 0.12) & (F.regexp_count(text, F.lit(r"(?U)\b\p{L}{3,}\b")) <= signals)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, pos, kind of each line, first match wins: blank, leader, caption, section, numbered, bullet or text."""
    after = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    section = F.col("line").rlike(SECTION) & (F.length("line") < 150)
    rows = lines_of(docs).withColumns({
        "next": F.last(F.when(F.col("line") != "", F.col("line")), ignorenulls=True).over(after),
        "skeleton": F.sum(section.cast("int")).over(Window.partitionBy("doc_id")) >= 2,
    })
    line, following = F.col("line"), F.coalesce(F.col("next"), F.lit(""))
    words = word_count(line)
    title = words.between(1, 12) & (F.length(line) <= 90) & ~line.rlike(r":\s+\S+\s+\S+") & ~following.rlike(r"^\p{Ll}")
    kind = (
        F.when(line == "", "blank").when(line.rlike(LEADER), "leader").when(line.rlike(CAPTION), "caption")
        .when(line.rlike(SECTION) & (F.length(line) < 150), F.when(following.rlike(LEADER), "leader").otherwise("section"))
        .when(~F.col("skeleton") & line.rlike(NUMBERED) & title, "numbered").when(line.rlike(BULLET), "bullet").otherwise("text")
    )
    return rows.select("doc_id", "pos", "line", kind.alias("kind"))


def merge_lines(docs: DataFrame) -> DataFrame:
    """doc_id, block, type, text: consecutive text lines, and text after a bullet, join into one block."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = classify(docs).withColumn("before", F.lag("kind").over(order))
    joins = (F.col("kind") == "text") & F.coalesce(F.col("before").isin("text", "bullet"), F.lit(False))
    rows = rows.withColumn("block", F.sum((~joins).cast("int")).over(order)).where("kind NOT IN ('blank', 'leader')")
    kinds = F.create_map(*(F.lit(x) for x in ("caption", "caption", "section", "heading", "numbered", "heading", "bullet", "list", "text", "paragraph")))
    clean = F.when(F.col("kind") == "bullet", trim(F.regexp_replace("line", BULLET, ""))).otherwise(F.col("line"))
    agg = rows.groupBy("doc_id", "block").agg(F.min_by("kind", "pos").alias("kind"), F.sort_array(F.collect_list(F.struct("pos", clean.alias("s")))).alias("ls"))
    return agg.select("doc_id", "block", kinds[F.col("kind")].alias("type"), F.array_join(F.transform("ls", lambda x: x["s"]), " ").alias("text"))


def list_ratio(blocks: DataFrame) -> DataFrame:
    """doc_id, list_ratio to three places."""
    return blocks.groupBy("doc_id").agg(F.round(F.avg((F.col("type") == "list").cast("int")), 3).alias("list_ratio"))


def heading_titles(blocks: DataFrame) -> DataFrame:
    return blocks.where("type = 'heading'").select("doc_id", "pos", F.regexp_replace("text", NUMBER, "").alias("title"))


# -- structure -------------------------------------------------------------------------------------------------------


def sections(blocks: DataFrame) -> DataFrame:
    """doc_id, section, title, level, word_count: a heading opens a section; text before the first has none."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    head = F.col("type") == "heading"
    rows = blocks.withColumn("section", F.sum(head.cast("int")).over(order)).where("section > 0")
    counted = F.when(F.col("type").isin("paragraph", "list", "table"), word_count(F.col("text"))).otherwise(0)
    return rows.groupBy("doc_id", "section").agg(F.max(F.when(head, F.col("text"))).alias("title"), F.coalesce(F.max(F.when(head, F.col("level"))), F.lit(2)).alias("level"), F.sum(counted).alias("word_count"))


def looks_like_title(t: Column) -> Column:
    return F.length(t).between(3, 200) & t.rlike(r"\p{L}") & ~t.rlike(r"(?i)^microsoft word\s*-")


def titles(docs: DataFrame, blocks: DataFrame, stem: Column) -> DataFrame:
    """doc_id, title: the first heading of over three bytes, else the stem; at most 255 characters."""
    first = blocks.where((F.col("type") == "heading") & (F.octet_length("text") > 3)).groupBy("doc_id").agg(F.min_by("text", "pos").alias("h"))
    return docs.select("doc_id", stem.alias("stem")).join(first, "doc_id", "left").select("doc_id", F.left(F.coalesce("h", "stem"), F.lit(255)).alias("title"))


def short_title(found: Column, stem: Column) -> Column:
    """The first heading of a document's blocks that is no bare number and at most 200 characters, else the stem."""
    heads = F.filter(found, lambda x: (x["type"] == "heading") & (trim(x["text"]) != "") & (F.length(x["text"]) <= 200) & ~x["text"].rlike(r"^\d+\.\s*$"))
    return F.coalesce(F.get(F.transform(heads, lambda x: trim(x["text"])), F.lit(0)), stem)


def pages_shown(kind: Column, pages: Column) -> Column:
    """How a report states its pages."""
    return F.when(kind == "PDF", pages.cast("string")).when(kind.isin("CSV", "TSV", "XLSX", "JSON"), "n/a (dataset)").otherwise("n/a (flowed format)")


def page_list(pages: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(pages, F.lit(1))))
