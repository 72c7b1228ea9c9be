"""Citation suitability: BM25 of reference documents for the passages of a working document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import let

K1, B = 1.5, 0.75
MIN_AFFINITY, TOP, SHARED = 0.15, 3, 6
#: Words that don't count as terms (fixed values).
STOP = "the a an and or but if then else of to in on at by for with about against between into through during before after above below from up down out off over under again further once here there all any both each few more most other some such no nor not only own same so than too very can will just should now is are was were be been being have has had do does did doing this that these those it its it's they them their what which who whom whose when where why how as also may might must shall would could we you your our us he she his her him i me my mine ours theirs per via etc eg ie within without upon among across around because while whereas thus hence et al fig figure table section chapter".split()


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and inner hyphens, three characters or more, not all digits, no stop words."""
    raw = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s-]+", " "), r"\s+")
    bare = F.transform(raw, lambda t: F.btrim(t, F.lit("-")))
    return F.filter(bare, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$") & ~t.isin(*STOP))


def terms(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf): combined in each task before the shuffle."""
    return docs.select(id_col, F.explode(tokens(F.col("text"))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def windows(docs: DataFrame, id_col: str, size: int = 120) -> DataFrame:
    """Passages of `size` words of each document: id, passage, text."""
    w = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), lambda t: t != "")
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return docs.select(id_col, w.alias("w")).select(id_col, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i * size + 1, F.lit(size)), " "))).alias("passage", "text"))


#: Kinds of documents whose references can be compared, and passages of a document at most (fixed values).
KINDS, PASSAGES = ("PDF", "DOCX", "MD", "TXT"), 80


def document_text(text: Column, blocks: Column) -> Column:
    """The whole text, else the texts of the blocks."""
    return F.coalesce(F.nullif(text, F.lit("")), F.array_join(F.filter(F.transform(blocks, lambda x: x["text"]), lambda x: x != ""), " "))


def passages(prepared: DataFrame, id_col: str = "doc_id", size: int = 120, cap: int = PASSAGES) -> DataFrame:
    """id, passage, label, title, text of prepared documents (text, blocks): what precedes the first heading and each section
    with a text; windows of `size` words where that gives fewer than two."""
    found = F.col("blocks")
    heads = F.filter(F.transform(found, lambda x, i: F.when(x["type"] == "heading", i)), lambda i: i.isNotNull())
    joined = lambda a: F.trim(F.array_join(F.filter(F.transform(a, lambda x: x["text"]), lambda x: x != ""), " "))
    piece = lambda label, title, text: F.struct(label.alias("label"), title.alias("title"), text.alias("text"))

    def section(p: Column, i: Column) -> Column:
        end = F.coalesce(F.get("heads", i + 1), F.size(found))
        title = F.get(found, p)["text"]
        return piece(F.coalesce(F.nullif(title, F.lit("")), F.lit("Section")), title, joined(F.slice(found, p + 2, end - p - 1)))

    first = piece(F.lit("Preamble"), F.lit(""), joined(F.slice(found, 1, F.coalesce(F.get("heads", F.lit(0)), F.size(found)))))
    by_section = prepared.select(id_col, document_text(F.col("text"), found).alias("whole"), "blocks", heads.alias("heads"))
    by_section = by_section.withColumn("sections", F.filter(F.concat(F.array(first), F.transform("heads", section)), lambda x: x["text"] != ""))
    w = F.filter(F.split("whole", r"\s+"), lambda t: t != "")
    parts = by_section.withColumn("w", w).withColumn("n", F.ceil(F.size("w") / size).cast("int"))
    window = lambda i: piece(F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(" of "), F.col("n").cast("string")), F.lit(""), F.array_join(F.slice("w", i * size + 1, F.lit(size)), " "))
    windowed = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), window))
    chosen = F.when(F.size("sections") > 1, F.col("sections")).otherwise(F.coalesce(windowed, F.col("sections")))
    return parts.select(id_col, F.posexplode(F.slice(chosen, 1, cap)).alias("passage", "p")).select(id_col, "passage", "p.*")


def suited(docs: DataFrame, kind: Column) -> DataFrame:
    """Documents that can be compared; tables can't."""
    return docs.where(kind.isin(*KINDS))


def counted(words: Column) -> Column:
    """The distinct words of an array with their numbers, as an array (term, tf): equal words are neighbours once sorted."""

    def whole(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x != F.get(xs, i - 1)), i)), lambda i: i.isNotNull())
        one = lambda at: F.transform(at, lambda p, j: F.struct(F.get(xs, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(xs)) - p).cast("bigint").alias("tf")))
        return let(starts, one)

    return let(F.sort_array(words), whole)


#: Bytes of passages up to which tables of a few rows a passage and term go to all tasks.
FEW_BYTES = 4_000_000


def near(rows: DataFrame, passages: DataFrame, few: int = FEW_BYTES) -> DataFrame:
    """Rows that belong to passages, to be sent to all tasks where the passages are small; else they are shuffled."""
    size = passages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return F.broadcast(rows) if size <= few else rows


def bm25(passages: DataFrame, refs: DataFrame) -> DataFrame:
    """(passage_id, ref_id, term, contribution) for terms that both hold: an equi-join on the term.

    Terms are counted in their reference's row, and only those that a passage holds leave it, dealt by reference once; document
    frequencies are counted from these, lengths from all terms. Where passages are small, pairs stay in their reference's task.
    A term's idf falls with its frequency, and no pair without a shared term is ever made.
    """
    q = terms(passages, "passage_id").withColumnRenamed("tf", "qtf")
    words = refs.select("ref_id", tokens(F.col("text")).alias("words"))
    length = words.groupBy("ref_id").agg(F.sum(F.size("words").cast("bigint")).alias("len"))
    stats = refs.agg(F.count("*").alias("n")).crossJoin(length.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("total")))
    #: An inner explode would make Spark look for empty arrays first, by computing them twice.
    every = words.select("ref_id", F.explode_outer(counted(F.col("words"))).alias("t")).where("t IS NOT NULL").select("ref_id", "t.*")
    held = every.join(near(q.select("term").distinct(), passages), "term", "left_semi").repartition("ref_id")
    tf = held.groupBy("ref_id", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(length, "ref_id").join(near(q.join(df, "term"), passages), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("len") / F.greatest(F.lit(1.0), F.col("total") / F.col("n")))
    return rows.select("passage_id", "ref_id", "term", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm) * F.least("qtf", F.lit(5))).alias("contribution"))


def scores(parts: DataFrame) -> DataFrame:
    """(passage_id, ref_id, score)."""
    return parts.groupBy("passage_id", "ref_id").agg(F.sum("contribution").alias("score"))


def affinities(scored: DataFrame) -> DataFrame:
    """Scores as shares of the greatest one, to two places; the maximum is a one-row table.

    Pairs without a shared term have no row; their affinity is zero, and no match or report ever shows one.
    """
    top = scored.agg(F.max("score").alias("top"))
    return scored.crossJoin(F.broadcast(top)).select("passage_id", "ref_id", "score", F.round(F.col("score") / F.col("top"), 2).alias("affinity"))


def matches(aff: DataFrame) -> DataFrame:
    """The best three references of each passage that reach the least affinity."""
    w = Window.partitionBy("passage_id").orderBy(F.desc("affinity"), F.desc(F.round("score", 9)), "ref_id")
    return aff.where(F.col("affinity") >= MIN_AFFINITY).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP).select("passage_id", "ref_id", "affinity", "rank")


def evidence(parts: DataFrame, matched: DataFrame) -> DataFrame:
    """The six terms of each match that contribute most, in order."""
    w = Window.partitionBy("passage_id", "ref_id").orderBy(F.desc(F.round("contribution", 9)), "term")
    top = parts.join(matched.select("passage_id", "ref_id"), ["passage_id", "ref_id"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SHARED)
    return top.groupBy("passage_id", "ref_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), " ").alias("shared"))


def suitability(matched: DataFrame) -> DataFrame:
    """(ref_id, suitability, coverage): a hundred times the mean of its five best matched affinities, and how many."""
    w = Window.partitionBy("ref_id").orderBy(F.desc("affinity"), "passage_id")
    ranked = matched.withColumn("k", F.row_number().over(w))
    return ranked.groupBy("ref_id").agg(F.round(100 * F.avg(F.when(F.col("k") <= 5, F.col("affinity")))).cast("int").alias("suitability"), F.count("*").alias("coverage"))


def ranked(suited_refs: DataFrame) -> DataFrame:
    """References by suitability, the best first; ties by coverage, then id."""
    return suited_refs.orderBy(F.desc("suitability"), F.desc("coverage"), "ref_id")


def top_passages(matched: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("ref_id").orderBy(F.desc("affinity"), "passage_id")
    return matched.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("ref_id", "k", "passage_id", "affinity")


def tier(affinity: Column) -> Column:
    return F.when(affinity >= 0.85, "great").when(affinity >= 0.75, "okay").when(affinity > 0.65, "poor").otherwise("none")


def set_fingerprint(groups: DataFrame, by: str, text: Column, parts: int = 256) -> DataFrame:
    """One digest of a group's texts, whatever their order.

    Digests of texts are dealt by their first byte into parts; each part's sorted digests are hashed, then the parts'
    digests in order. A group of any size so spreads over tasks, and `parts` short rows meet in its last one.
    """
    digest = groups.select(by, F.sha2(text, 256).alias("d")).withColumn("part", F.pmod(F.conv(F.left("d", F.lit(2)), 16, 10).cast("int"), F.lit(parts)))
    hashed = digest.groupBy(by, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "|"), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "|")
    return hashed.groupBy(by).agg(F.sha2(whole, 256).alias("fingerprint"))


def exact_fingerprint(groups: DataFrame, by: str, text: Column) -> DataFrame:
    """The digest of each group's sorted digests joined by `|`, whatever their order: of compilations and reference sets that a
    user has picked, whose digests fit in a task (64 bytes a text). `set_fingerprint` serves groups of any size."""
    digest = groups.select(by, F.sha2(F.coalesce(text, F.lit("")), 256).alias("d"))
    return digest.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "|"), 256).alias("fingerprint"))
