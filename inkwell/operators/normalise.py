"""Cleaning of plain text: page furniture out, lines to blocks, tables and formulas declared, a title from the furniture.

Every rule looks at a line and its neighbours. Where lines or blocks come as rows, the rules are windows over a document's
lines, and the texts are shuffled once, by document. Where a row has its whole document (`normalise`), what a line is by
itself goes as a number to a task, which walks through all lines at once, so nothing is shuffled. The walk from a page marker
through its surroundings is a comparison of running counts: a line is reached if the nearest marker is at most `REACH` lines
away and no line that stops the walk lies between.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from inkwell.functions.text import collapse, held, let, split_lines, trim, word_count

from . import blocks as b

#: Lines a walk takes, lines it drops above a bare page number, occurrences that make a line furniture (fixed values).
REACH, LONE, REPEATS = 12, 4, 2
TABLE_NOTE, MATH_NOTE = "[table: structure not preserved]", "[equation: notation degraded in text-layer extraction]"


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def in_order() -> WindowSpec:
    return by_doc().orderBy("pos")


#: Tasks that the texts of one split are dealt over.
SHARES = 4


def dealt(docs: DataFrame) -> DataFrame:
    """Documents by doc_id over so many tasks that what one of them sorts doesn't grow with the table; all windows over lines
    stay within these."""
    return docs.repartition(SHARES * docs.rdd.getNumPartitions(), "doc_id")


def marked_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, marker (label, number or null), dropped: markers and the running headers and footers at them.

    Where a document has page labels, lines next to one go both ways as long as they recur; else up to four short lines
    above each lone page number go, unless they read like content.
    """
    rows = b.lines_of(dealt(docs.select("doc_id", "text"))).withColumns({"label": F.col("line").rlike(b.PAGE_LABEL), "sig": b.signature(F.col("line"))})
    rows = rows.withColumns({
        "labelled": F.max("label").over(by_doc()),
        "alone": (F.coalesce(F.lag("line").over(in_order()), F.lit("")) == "") | (F.coalesce(F.lead("line").over(in_order()), F.lit("")) == ""),
        "recurs": (F.col("sig") != "") & (F.count("*").over(Window.partitionBy("doc_id", "sig")) >= REPEATS),
    })
    line = F.col("line")
    content = line.rlike(b.BULLET) | line.rlike(b.NUMBERED) | line.rlike(b.SECTION) | line.rlike(r"[.!?,;:]$") | (F.length(line) > 80)
    rows = rows.withColumns({
        "marker": F.when(F.col("label"), "label").when(~F.col("labelled") & line.rlike(b.PAGE_NUMBER) & F.col("alone"), "number"),
        "stops": ((line != "") & F.when(F.col("labelled"), ~F.col("recurs")).otherwise(content)).cast("int"),
    })
    free = ((line != "") & F.col("marker").isNull()).cast("int")
    rows = rows.withColumns({"stopped": F.sum("stops").over(in_order()), "free": F.sum(free).over(in_order()), "own": free})
    mark = F.when(F.col("marker").isNotNull(), F.struct("stopped", "stops", "free"))
    rows = rows.withColumns({"below": F.first(mark, True).over(in_order().rowsBetween(1, REACH)), "above": F.last(mark, True).over(in_order().rowsBetween(-REACH, -1))})
    up = F.col("below.stopped") - F.col("below.stops") == F.col("stopped") - F.col("stops")
    few = F.col("below.free") - F.col("free") + F.col("own") <= LONE
    reached = F.when(F.col("labelled"), F.coalesce(up, F.lit(False)) | F.coalesce(F.col("stopped") == F.col("above.stopped"), F.lit(False))).otherwise(F.coalesce(up & few, F.lit(False)))
    return rows.select("doc_id", "pos", "line", "marker", (F.col("marker").isNotNull() | ((line != "") & reached)).alias("dropped"))


def table_lines(marked: DataFrame) -> DataFrame:
    """With `opens` (a header line before a row line) and `table_row` (such headers and the rows that follow them)."""
    line, kept = F.col("line"), ~F.col("dropped")
    shaped = marked.withColumns({"header": b.is_table_header(line) & kept, "row": b.is_table_row(line) & kept})
    solid = line != ""
    rows = shaped.withColumns({
        "header_before": F.last(F.when(solid, F.col("header")), True).over(in_order().rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.last(F.when(solid, F.struct("line", "row")), True).over(by_doc().orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)),
    })
    opens = F.col("header") & F.coalesce(F.col("next.row"), F.lit(False))
    event = F.when(F.col("row") & F.coalesce("header_before", F.lit(False)), 1).when(~solid | (kept & ~F.col("row")), 0)
    rows = rows.withColumns({"opens": opens, "event": event})
    inside = F.last("event", True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)) == 1
    return rows.withColumn("table_row", F.col("opens") | (F.col("row") & F.coalesce(inside, F.lit(False))))


def kinds(marked: DataFrame) -> DataFrame:
    """Lines that stay, each with its kind; first match wins: blank, row, leader, caption, section, numbered, bullet, text."""
    line = F.col("line")
    section = line.rlike(b.SECTION) & (F.length(line) < 150)
    rows = table_lines(marked).withColumn("skeleton", F.sum((section & ~F.col("dropped")).cast("int")).over(by_doc()) >= 2)
    following = F.coalesce(F.col("next.line"), F.lit(""))
    title = word_count(line).between(1, 12) & (F.length(line) <= 90) & ~line.rlike(r":\s+\S+\s+\S+") & ~following.rlike(r"^\p{Ll}")
    kind = (
        F.when(line == "", "blank").when(F.col("table_row"), "row").when(line.rlike(b.LEADER), "leader").when(line.rlike(b.CAPTION), "caption")
        .when(section, F.when(following.rlike(b.LEADER), "leader").otherwise("section"))
        .when(~F.col("skeleton") & line.rlike(b.NUMBERED) & title, "numbered").when(line.rlike(b.BULLET), "bullet").otherwise("text")
    )
    return rows.where("NOT dropped").select("doc_id", "pos", "line", "opens", kind.alias("kind"))


def clean_blocks(docs: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, part, type, text, level, table_row, math_degraded: blocks in order of pos and part, notes among them."""
    rows = kinds(marked_lines(docs) if marked is None else marked).withColumn("before", F.lag("kind").over(in_order()))
    joins = (F.col("kind") == "text") & F.coalesce(F.col("before").isin("text", "bullet"), F.lit(False))
    rows = rows.withColumn("block", F.sum((~joins).cast("int")).over(in_order())).where("kind NOT IN ('blank', 'leader')")
    clean = F.when(F.col("kind") == "bullet", F.regexp_replace("line", b.BULLET, "")).otherwise(F.col("line"))
    merged = rows.groupBy("doc_id", "block").agg(F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"), F.max("opens").alias("opens"), F.sort_array(F.collect_list(F.struct("pos", clean.alias("s")))).alias("ls"))
    names = F.create_map(*(F.lit(x) for x in ("caption", "caption", "section", "heading", "numbered", "heading", "bullet", "list", "text", "paragraph", "row", "paragraph")))
    whole = merged.select("doc_id", "pos", "kind", "opens", names[F.col("kind")].alias("type"), trim(F.array_join(F.transform("ls", lambda x: x["s"]), " ")).alias("text")).where("text <> ''")
    math = whole.withColumn("math", (F.col("kind") == "text") & b.is_math_dense(F.col("text")))

    def part(n: int, kind: Column, text: Column, when: Column, level: Column, row: Column, degraded: Column) -> Column:
        return F.when(when, F.struct(F.lit(n).alias("part"), kind.alias("type"), text.alias("text"), level.cast("int").alias("level"), row.alias("table_row"), degraded.alias("math_degraded")))

    no, none = F.lit(False), F.lit(None)
    parts = F.array(
        part(0, F.lit("note"), F.lit(TABLE_NOTE), F.col("opens"), none, no, no),
        part(1, F.col("type"), F.col("text"), F.lit(True), F.when(F.col("type") == "heading", 2), F.col("kind") == "row", F.col("math")),
        part(2, F.lit("note"), F.lit(MATH_NOTE), F.col("math"), none, no, no),
    )
    return math.select("doc_id", "pos", F.explode(F.array_compact(parts)).alias("p")).select("doc_id", "pos", "p.*")


def is_title_like(line: Column) -> Column:
    return F.length(line).between(5, 70) & line.rlike(r"\p{L}") & ~line.contains(":") & ~line.rlike(b.LEADER) & ~line.rlike(b.PAGE_LABEL) & word_count(line).between(1, 10)


def furniture(marked: DataFrame) -> DataFrame:
    """doc_id, removed (all dropped lines in order), seed: the title that the running headers give."""
    gone = marked.where("dropped").withColumns({"key": F.lower(collapse(F.col("line"))), "fit": F.col("marker").isNull() & is_title_like(F.col("line"))})
    by_key = gone.groupBy("doc_id", "key", "fit").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.count("*").alias("n"), F.collect_list(F.struct("pos", "line")).alias("all"))
    fits = F.array_sort(F.filter(F.collect_list(F.struct("pos", "line", "n", "fit")), lambda x: x["fit"]))
    per_doc = by_key.groupBy("doc_id").agg(F.transform(F.array_sort(F.flatten(F.collect_list("all"))), lambda x: x["line"]).alias("removed"), fits.alias("fits"))
    most = F.array_max(F.transform("fits", lambda x: F.struct(x["n"].alias("n"), (-x["pos"]).alias("p"), x["line"].alias("line"))))["line"]
    few = F.array_join(F.transform("fits", lambda x: x["line"]), " ")
    return per_doc.select("doc_id", "removed", F.when(F.size("fits") <= 3, few).otherwise(most).alias("seed"))


def header_of(lines: Column, seed: Column) -> Column:
    """A running header as a title, or the fuller line near the top that holds it; null if it's no title."""
    top = F.slice(lines, 1, 35)
    fuller = lambda x: ~x.contains(":") & (F.length(x) > F.length(seed)) & (F.length(x) <= 100) & F.lower(x).contains(F.lower(seed)) & ~x.rlike(b.LEADER)
    title = F.coalesce(F.get(F.filter(top, fuller), F.lit(0)), seed)
    return F.when((seed != "") & (F.length(title) >= 5) & title.rlike(r"\p{L}"), title)


FIELDS = ("pos", "part", "type", "text", "level", "table_row", "math_degraded", "rows")
ROWS = "array<array<string>>"
#: Blocks as sources give them: a table has rows of cells, the others a text.
SOURCE_BLOCKS = f"array<struct<type:string,text:string,level:int,rows:{ROWS}>>"


def block_of(pos: Column, kind: Column, text: Column, level: Column, rows: Column | None = None) -> Column:
    no = F.lit(False)
    values = (pos, F.lit(1), kind, text, level.cast("int"), no, no, F.lit(None).cast(ROWS) if rows is None else rows)
    return F.struct(*(v.alias(n) for v, n in zip(values, FIELDS, strict=True)))


def cells_of(rows: Column) -> Column:
    """The cells of a table that hold something, row by row."""
    return F.filter(F.flatten(rows), lambda c: trim(c) != "")


def given_blocks(found: Column) -> Column:
    """Blocks of a source in place; a table's text is its cells, one a line; tables without a cell go."""
    filled = F.filter(found, lambda x: (x["type"] != "table") | (F.size(cells_of(x["rows"])) > 0))
    text = lambda x: F.when(x["type"] == "table", F.array_join(cells_of(x["rows"]), "\n")).otherwise(F.coalesce(x["text"], F.lit("")))
    return F.transform(filled, lambda x, i: block_of(i, x["type"], text(x), x["level"], F.when(x["type"] == "table", x["rows"])))


def plain_blocks(text: Column, block) -> Column:
    """Blocks of a text's lines without cleaning, in place."""
    lines = F.transform(split_lines(text), lambda x, i: F.struct(i.alias("pos"), block(trim(x)).alias("b"), trim(x).alias("line")))
    return F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: block_of(x["pos"], x["b"]["type"], x["b"]["text"], x["b"]["level"]))


# -- documents in their rows ------------------------------------------------------------------------------------------

#: What a line may be by itself, each a bit.
BLANK, LABEL, ALONE, STOP, HEADER, ROW, LEADER, CAPTION, SECTION, NUMBERED, TITLE, BULLET, LOWER = (1 << i for i in range(13))
KINDS = ("blank", "row", "leader", "caption", "section", "numbered", "bullet", "text")
NAMES = {"row": "paragraph", "caption": "caption", "section": "heading", "numbered": "heading", "bullet": "list", "text": "paragraph"}
WALKED = StructType([
    StructField("gone", ArrayType(StructType([StructField("pos", IntegerType()), StructField("marker", BooleanType())]))),
    StructField("kept", ArrayType(IntegerType())),
    StructField("blocks", ArrayType(StructType([StructField(x, IntegerType()) for x in ("pos", "first", "n", "kind")] + [StructField("opens", BooleanType())]))),
])


def bits_of(line: Column) -> Column:
    """What a trimmed line is by itself; patterns that only short lines can meet are tried on these."""
    hit = lambda bit, when: F.when(when, F.lit(bit)).otherwise(F.lit(0))
    digit = line.rlike(r"^\s*\d")
    numbered = line.rlike(b.NUMBERED)
    title = numbered & (F.length(line) <= 90) & word_count(line).between(1, 12) & ~line.rlike(r":\s+\S+\s+\S+")
    by_digit = hit(ALONE, line.rlike(b.PAGE_NUMBER)) + hit(SECTION, line.rlike(b.SECTION) & (F.length(line) < 150)) + hit(NUMBERED, numbered) + hit(TITLE, title)
    every = (
        hit(LABEL, line.rlike(b.PAGE_LABEL)) + hit(STOP, (F.length(line) > 80) | line.rlike(r"[.!?,;:]$")) + hit(HEADER, b.is_table_header(line)) + hit(ROW, b.is_table_row(line))
        + hit(LEADER, line.contains(".") & line.rlike(b.LEADER)) + hit(CAPTION, line.rlike(b.CAPTION)) + hit(BULLET, line.rlike(b.BULLET)) + hit(LOWER, line.rlike(r"^\p{Ll}"))
    )
    return F.when(line == "", F.lit(BLANK)).otherwise(every + F.when(digit, by_digit).otherwise(F.lit(0)))


@F.arrow_udf(WALKED)
def walked(bits: pa.Array, signs: pa.Array) -> pa.Array:
    """Of documents' lines, as bits_of has them: the lines that go (and which are markers), those that stay if any go, and the
    blocks (place of the first line, its place among those that stay, number of lines, kind, whether it opens a table).

    signs: the signatures of the lines of documents with page labels, else null. The rules are those of marked_lines, table_lines,
    kinds and clean_blocks.
    """
    starts = (bits.offsets.to_numpy() - bits.offsets[0].as_py()).astype(np.int64)
    f = bits.flatten().to_numpy()
    n, docs = len(f), len(bits)
    doc, here = np.repeat(np.arange(docs), np.diff(starts)), np.arange(n)
    is_ = lambda bit: (f & bit) > 0
    ends = starts[1:][doc]
    begins = starts[:-1][doc]
    solid = ~is_(BLANK)

    def upto(hit: np.ndarray) -> np.ndarray:
        """The last hit at each place or before, -1 if none."""
        return np.maximum.accumulate(np.where(hit, here, -1))

    def before(hit: np.ndarray) -> np.ndarray:
        """The last hit before each place in its document, -1 if none."""
        last = np.concatenate(([-1], upto(hit)[:-1])) if n else here
        return np.where(last >= begins, last, -1)

    def after(hit: np.ndarray) -> np.ndarray:
        """The first hit after each place in its document, -1 if none."""
        nxt = np.append(np.minimum.accumulate(np.where(hit, here, n)[::-1])[::-1][1:], n) if n else here
        return np.where(nxt < ends, nxt, -1)

    def at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
        return (places >= 0) & values[places]

    per_doc = lambda hit: np.bincount(doc[hit], minlength=docs)[doc]
    labelled = per_doc(is_(LABEL)) > 0
    edge = (here == begins) | (here == ends - 1)
    blank_near = edge | np.concatenate(([False], ~solid[:-1])) | np.append(~solid[1:], False) if n else solid
    marker = is_(LABEL) | (~labelled & is_(ALONE) & blank_near)
    recurs = np.zeros(n, bool)
    if labelled.any():
        coded = signs.flatten().dictionary_encode()
        key, count = np.unique(doc[labelled] * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True, return_counts=True)[1:]
        recurs[labelled] = (count[key] >= REPEATS) & (pa.compute.binary_length(coded.dictionary).to_numpy()[coded.indices.to_numpy()] > 0)
    stops = solid & np.where(labelled, ~recurs, is_(STOP | BULLET | NUMBERED | SECTION))
    stopped = np.cumsum(stops)
    free = solid & ~marker
    freed = np.cumsum(free)
    down, up = before(marker), after(marker)
    near_up = (up >= 0) & (up - here <= REACH)
    near_up &= (stopped - stops)[up] == stopped - stops
    near_down = (down >= 0) & (here - down <= REACH)
    near_down &= stopped[down] == stopped
    few = freed[up] - freed + free <= LONE
    gone = marker | (solid & np.where(labelled, near_up | near_down, near_up & few))

    header, row = is_(HEADER) & ~gone, is_(ROW) & ~gone
    previous, following = before(solid), after(solid)
    opens = header & at(row, following)
    starts_rows = row & at(header, previous)
    event = starts_rows | ~solid | (~gone & ~row)
    last = upto(event)
    inside = (last >= begins) & starts_rows[last]
    in_table = opens | (row & inside)
    skeleton = per_doc(is_(SECTION) & ~gone) >= 2
    numbered = ~skeleton & is_(NUMBERED) & is_(TITLE) & ~at(is_(LOWER), following)
    leader = is_(LEADER) | (is_(SECTION) & ~is_(CAPTION) & at(is_(LEADER), following))
    rules = [~solid, in_table, leader, is_(CAPTION), is_(SECTION), numbered, is_(BULLET)]
    kind = np.select(rules, range(len(rules)), len(rules))

    kept = np.flatnonzero(~gone)
    own, mine = kind[kept], doc[kept]
    joins = np.zeros(len(kept), bool)
    text, bullet = KINDS.index("text"), KINDS.index("bullet")
    joins[1:] = (own[1:] == text) & (mine[1:] == mine[:-1]) & ((own[:-1] == text) | (own[:-1] == bullet))
    heads = np.flatnonzero(~joins)
    size = np.diff(np.append(heads, len(kept)))
    shown = (own[heads] != KINDS.index("blank")) & (own[heads] != KINDS.index("leader"))
    heads, size = heads[shown], size[shown]
    head = kept[heads]
    kept_from = np.searchsorted(kept, starts)

    def lists(at: np.ndarray, values: pa.Array, none: np.ndarray | None = None) -> pa.Array:
        cuts = np.searchsorted(at, starts)
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values, mask=None if none is None else pa.array(none))

    int_ = lambda x: pa.array(x.astype(np.int32))
    lost = np.flatnonzero(gone)
    whole = np.bincount(doc[lost], minlength=docs) == 0
    removed = lists(lost, pa.StructArray.from_arrays([int_(lost - begins[lost]), pa.array(marker[lost])], ["pos", "marker"]))
    stay = kept[~whole[mine]]
    left = lists(stay, int_(stay - begins[stay]), whole)
    found = lists(head, pa.StructArray.from_arrays([int_(head - begins[head]), int_(heads - kept_from[doc[head]]), int_(size), int_(kind[head]), pa.array(opens[head])], ["pos", "first", "n", "kind", "opens"]))
    return pa.StructArray.from_arrays([removed, left, found], ["gone", "kept", "blocks"])


def blocks_in(lines: Column, walk: Column) -> Column:
    """The blocks of a document from its lines and what walked gives of them."""
    kind = lambda x, *names: x["kind"].isin(*(KINDS.index(n) for n in names))
    no, none = F.lit(False), F.lit(None)

    def joined(kept: Column) -> Column:
        def text(x: Column) -> Column:
            mine = F.slice(kept, x["first"] + 1, x["n"])
            clean = lambda ls: F.concat(F.array(F.regexp_replace(ls[0], b.BULLET, "")), F.slice(ls, 2, x["n"]))
            return trim(F.array_join(F.when(kind(x, "bullet"), let(mine, clean)).otherwise(mine), " "))

        made = F.filter(F.transform(walk["blocks"], lambda x: F.struct(x["pos"].alias("pos"), x["kind"].alias("kind"), x["opens"].alias("opens"), text(x).alias("text"))), lambda x: x["text"] != "")
        return F.transform(made, lambda x: F.struct(x["pos"], x["kind"], x["opens"], x["text"], (kind(x, "text") & b.is_math_dense(x["text"])).alias("math")))

    def part(pos: Column, n: int, kind: Column, text: Column, level: Column, row: Column, degraded: Column) -> Column:
        values = (pos, F.lit(n), kind, text, level.cast("int"), row, degraded, none.cast(ROWS))
        return F.struct(*(v.alias(name) for v, name in zip(values, FIELDS, strict=True)))

    def parts(x: Column) -> Column:
        names = F.element_at(F.array(*(F.lit(NAMES.get(k)) for k in KINDS)), x["kind"] + 1)
        heading = F.when(kind(x, "section", "numbered"), 2)
        block = part(x["pos"], 1, names, x["text"], heading, kind(x, "row"), x["math"])
        before = F.when(x["opens"], part(x["pos"], 0, F.lit("note"), F.lit(TABLE_NOTE), none, no, no))
        after = F.when(x["math"], part(x["pos"], 2, F.lit("note"), F.lit(MATH_NOTE), none, no, no))
        return F.when(x["opens"] | x["math"], F.array_compact(F.array(before, block, after))).otherwise(F.array(block))

    kept = F.when(walk["kept"].isNull(), lines).otherwise(F.transform(walk["kept"], lambda i: F.get(lines, i)))
    return F.flatten(F.transform(let(kept, joined), parts))


def furniture_in(lines: Column, gone: Column) -> Column:
    """removed and header of a document, as furniture and header_of give them, from its lines and the places of those that go; null
    if none go."""
    fit = F.filter(F.transform(gone, lambda x: F.struct(x["pos"].alias("pos"), F.get(lines, x["pos"]).alias("line"), x["marker"].alias("marker"))), lambda x: ~x["marker"] & is_title_like(x["line"]))
    sorted_ = F.array_sort(F.transform(fit, lambda x: F.struct(F.lower(collapse(x["line"])).alias("key"), x["pos"].alias("pos"), x["line"].alias("line"))))

    def counted(xs: Column) -> Column:
        heads = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (F.get(xs, i - 1)["key"] != x["key"]), i)), lambda i: i.isNotNull())
        size = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(xs)) - F.get(at, j)
        return let(heads, lambda at: F.transform(at, lambda i, j: F.struct(F.get(xs, i)["pos"].alias("pos"), F.get(xs, i)["line"].alias("line"), size(at, j).alias("n"))))

    def seed(fits: Column) -> Column:
        most = F.array_max(F.transform(fits, lambda x: F.struct(x["n"].alias("n"), (-x["pos"]).alias("p"), x["line"].alias("line"))))["line"]
        return F.when(F.size(fits) <= 3, F.array_join(F.transform(F.array_sort(fits), lambda x: x["line"]), " ")).otherwise(most)

    removed = F.transform(gone, lambda x: F.get(lines, x["pos"]))
    header = let(let(let(sorted_, counted), seed), lambda s: F.when(s != "", header_of(lines, s)))
    return F.when(F.size(gone) > 0, F.struct(removed.alias("removed"), header.alias("header")))


def cleaned(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, columns to carry, text (rebuilt from the blocks, but of Markdown as it is), blocks (in order), removed, header,
    size_bytes, kind, parser: one row a document, in its row. docs: doc_id, text, kind, source_blocks, parser and what to carry."""
    c = F.col
    lined = docs.withColumn("_lines", F.when(c("parser") == "text", F.transform(split_lines(F.make_valid_utf8(F.coalesce("text", F.lit("")))), trim)).otherwise(F.array().cast("array<string>")))
    marked = lined.withColumn("_bits", F.transform("_lines", bits_of))
    label = F.exists("_bits", lambda x: x.bitwiseAND(F.lit(LABEL)) > 0)
    walk = marked.withColumn("_walk", walked("_bits", F.when(label, F.transform("_lines", b.signature))))
    source = F.coalesce("text", F.lit(""))
    paragraphs = F.transform(b.paragraph_blocks(source), lambda x: block_of(x["pos"], x["type"], x["text"], x["level"]))
    spare = F.when(c("kind") == "PDF", paragraphs).otherwise(plain_blocks(source, b.text_block))
    found = let(blocks_in(c("_lines"), c("_walk")), lambda x: F.struct(F.when(F.size(x) > 0, x).otherwise(spare).alias("blocks"), text_of(x).alias("text")))
    as_marked = F.struct(plain_blocks(c("text"), b.markdown_block).alias("blocks"), c("text").alias("text"))
    as_given = let(given_blocks(c("source_blocks")), lambda x: F.struct(x.alias("blocks"), text_of(x).alias("text")))
    made = walk.select(
        "doc_id", *carry, "kind", "parser", F.octet_length(source).alias("size_bytes"), furniture_in(c("_lines"), c("_walk.gone")).alias("furniture"),
        F.when(c("parser") == "markdown", as_marked).when(c("parser") == "given", as_given).otherwise(found).alias("made"),
    )
    return held(made).select("doc_id", *carry, "made.text", "made.blocks", F.coalesce("furniture.removed", F.array().cast("array<string>")).alias("removed"), "furniture.header", "size_bytes", "kind", "parser", ratio_of(c("made.blocks")).alias("list_ratio"))


def with_parts(docs: DataFrame, parser: Column | None = None, *carry: str) -> DataFrame:
    """doc_id, text, kind, source_blocks, parser and columns to carry."""
    kind = F.col("kind") if "kind" in docs.columns else F.lit(None).cast("string")
    given = F.col("source_blocks") if "source_blocks" in docs.columns else F.lit(None).cast(SOURCE_BLOCKS)
    by_kind = F.when(given.isNotNull(), "given").when(kind == "MD", "markdown").when(kind == "PDF", "text").otherwise(b.parser_expr())
    return docs.select("doc_id", "text", *carry, kind.alias("kind"), given.alias("source_blocks"), (F.coalesce(by_kind, F.lit("text")) if parser is None else parser).alias("parser"))


def normalise(docs: DataFrame) -> DataFrame:
    """doc_id, text (rebuilt from the blocks), blocks (in order), list_ratio, removed, header, size_bytes: one row a document.

    Without a block that stays, the blocks are the plain lines, or a PDF's paragraphs (docs may have a `kind`). A null text is empty.
    """
    return cleaned(with_parts(docs, F.lit("text"))).select("doc_id", "text", "blocks", "removed", "header", "size_bytes", "list_ratio")


def text_of(blocks: Column) -> Column:
    """The text of all blocks but notes."""
    return F.array_join(F.transform(F.filter(blocks, lambda x: x["type"] != "note"), lambda x: x["text"]), "\n")


def ratio_of(blocks: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(F.size(F.filter(blocks, lambda x: x["type"] == "list")), F.size(blocks)), 3), F.lit(0.0))


def prepare(docs: DataFrame, *carry: str) -> DataFrame:
    """Documents as normalise gives them, and their parser and source type: plain text cleaned, Markdown with the blocks of its
    own marks, documents with `source_blocks` with these; all in their rows. docs: doc_id, text, columns to carry and, from files,
    kind and source_blocks."""
    rows = cleaned(with_parts(docs, None, *carry), *carry)
    by_parser = F.when(F.col("parser") == "markdown", "MD").otherwise("TXT")
    source_type = by_parser if "kind" not in docs.columns else F.when(F.col("kind").isin("PDF", "DOCX"), F.col("kind")).otherwise(by_parser)
    return rows.withColumn("source_type", source_type).drop("kind")
