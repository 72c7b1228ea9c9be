"""Line deduplication by a deletion-neighbourhood join. DataFrame functions only.

Lines are trimmed and compared by words. A line goes if an equal line occurs earlier (by document id, then position),
or if a line within one word's edit (one word put in, left out or replaced) first occurs earlier than its own first
occurrence. Every line with a word takes part (`min_words`). By default lines of one or two words go as equal lines only: an
edit leaves no more than half of their words, so any one-word line would be a near copy of any other (`near_words`, which
may be 1; figures in the README).

Variants: leaving out one word of each of two lines at the same place gives equal rests if the lines differ there by a
replacement, and a line without one word equals the shorter line if a word was put in. So each line emits the hash of
its rest for every word, keyed by place, and its own hash; equal keys are joined by aggregation to the earliest member,
never by pairs, and what is found is verified on the words. Only lines that share a half with another line can be within
one edit (the edit spares either the first or the last half), so only those emit variants, and only of the other half.

Lines are told apart by two 64-bit hashes; variants by one with place and size, as what they find is verified: a clash
there could hide a near copy but never drop a line. A document's rows are rebuilt from its text by leaving out
positions, which keeps the rest as it is.

Nulls and extremes: a null text has no lines and stays null; blank lines stay; lines of any length are compared whole;
repeated rows (equal id and text) are one document to the comparison and rebuilt alike; null ids come first; an empty
table gives an empty result. Extra columns stay, whatever their names; only those called as the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import running

from .common import SPACE_CLASS, SPACES, Workspace, let, named, unused, words

#: Words a line needs to be compared at all, and to be compared inexactly.
MIN_WORDS, NEAR_WORDS = 1, 3
LINE = ["h1", "h2"]
#: Words of a line up to which its rests are hashed one by one; beyond, a rest's hash is put together from its two ends.
LONG = 64


def hashes(*cols: Column, names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(*cols).alias(names[0]), F.xxhash64(F.lit(11), *cols).alias(names[1])]


def halves(w: Column) -> Column:
    """Hashes of the first and last words, half as many as the line has, and as a line shorter by one has."""
    n = F.size(w)
    one = lambda k, tag, part: F.xxhash64(F.lit(tag), k, part)
    both = lambda k: (one(k, "first", F.slice(w, F.lit(1), k)), one(k, "last", F.slice(w, n - k + 1, k)))
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(half == less, F.array(*both(half))).otherwise(F.array(*both(half), *both(less)))


def occurrences(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """A row for each line that takes part: its document's key and id, position, hashes and, if compared inexactly, halves."""
    exploded = docs.select("k1", "k2", "_id", F.posexplode(F.split(F.coalesce("_text", F.lit("")), "\n", -1)).alias("pos", "line"))
    line = exploded.withColumn("line", F.btrim("line", F.lit(SPACES))).where("line <> ''")
    #: A trimmed line starts and ends with a word, so it is split as it stands.
    cut = line.select("k1", "k2", "_id", "pos", F.split("line", SPACE_CLASS + "+", -1).alias("w"))
    if min_words > 1:
        cut = cut.where(F.size("w") >= min_words)
    near = F.when(F.size("w") >= near_words, halves(F.col("w"))).otherwise(F.array().cast("array<bigint>"))
    return cut.select("k1", "k2", "_id", "pos", *hashes(F.col("w"), names=("h1", "h2")), F.size("w").alias("size"), near.alias("halves"))


def candidates(distinct: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another distinct line; words after `after` or up to `upto` may differ."""
    keyed = distinct.select(*LINE, "first", "size", F.posexplode("halves").alias("nth", "key"))
    who = F.struct(*LINE)
    shared = keyed.groupBy("key").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select("key")
    half = F.floor((F.col("size") - F.floor(F.col("nth") / 2)) / 2).cast("int")
    front = F.col("nth") % 2 == 0
    found = keyed.join(shared, "key", "left_semi").groupBy(*LINE)
    return found.agg(F.min("first").alias("first"), F.min(F.when(front, half)).alias("after"), F.max(F.when(~front, F.col("size") - half)).alias("upto"))


def variants(lines: DataFrame, long: int) -> DataFrame:
    """(rest, place, size): the line without each word in which it may differ, and itself with place 0.

    A line of more than `long` words is hashed as all of its words' hashes with their places, joined by exclusive or. Of a rest,
    the words before the gap keep their places and those behind it move up by one, so running totals of both give each rest
    in one step. A line of just `long` words is hashed both ways, as it may be the rest of a longer one.
    """

    def xor(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x))

    def placed(w: Column, less: int) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, i + 1 - less))

    def all_of(w: Column) -> Column:
        n = F.size(w)
        places = F.filter(F.sequence(F.lit(1), n), lambda i: (i > F.coalesce("after", n)) | (i <= F.coalesce("upto", F.lit(0))))
        rest = lambda i: F.concat(F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, F.greatest(n - i, F.lit(0))))
        one = lambda i, r: F.struct(r.alias("rest"), i.alias("place"), n.alias("size"))
        short = lambda: F.concat(F.transform(places, lambda i: one(i, F.xxhash64(rest(i)))), F.array(one(F.lit(0), F.xxhash64(w))))
        whole = lambda: F.array(one(F.lit(0), xor(placed(w, 0))))

        def split(ends: Column) -> Column:
            """ends: of each word its place's hash and that of the place before, and running totals before it of both."""
            behind = lambda i: xor(F.transform(F.slice(ends, n, F.lit(1)), lambda e: e["before"].bitwiseXOR(e["moved"]))).bitwiseXOR(F.get(ends, i - 1)["before"]).bitwiseXOR(F.get(ends, i - 1)["moved"])
            return F.transform(places, lambda i: one(i, F.get(ends, i - 1)["stays"].bitwiseXOR(behind(i))))

        stays, moved = running(placed(w, 0), xor, lambda x, y: x.bitwiseXOR(y)), placed(w, 1)
        ends = F.arrays_zip(stays.alias("stays"), running(moved, xor, lambda x, y: x.bitwiseXOR(y)).alias("before"), moved.alias("moved"))
        return F.when(n < long, short()).when(n == long, F.concat(short(), whole())).otherwise(F.concat(let(ends, split), whole()))

    by_hash = F.transform("w", lambda x: F.xxhash64(x))
    return lines.select(*LINE, "first", F.explode(let(by_hash, all_of)).alias("v")).select(*LINE, "first", "v.*")


def within_one_edit(a: Column, b: Column) -> Column:
    """Equal words at the start and at the end leave at most one word of the longer line."""
    n = F.greatest(F.size(a), F.size(b))

    def start(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(at == 0, n).otherwise(at - 1)

    return start(a, b) + start(F.reverse(a), F.reverse(b)) >= n - 1


def near_lines(distinct: DataFrame, docs: DataFrame, ws: Workspace) -> DataFrame:
    """Distinct lines (h1, h2) that have an earlier line within one word's edit."""
    some = ws.cut(candidates(distinct))
    wanted = some.select("*", "first.k1", "first.k2", "first.pos").groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", *LINE, "first", "after", "upto")).alias("takes"))
    text = docs.select("k1", "k2", "_text")
    split = text.join(wanted, ["k1", "k2"]).select("takes", F.split("_text", "\n", -1).alias("ls"))
    lines = split.select(F.explode(F.transform("takes", lambda t: F.struct(t.alias("t"), F.get("ls", t["pos"]).alias("line")))).alias("x")).select("x.t.*", words(F.col("x.line")).alias("w"))
    lines = ws.cut(lines.select(*LINE, "first", "after", "upto", "w").dropDuplicates(LINE))
    own = ws.cut(variants(lines, LONG))
    # Replacement: equal rests at the same place of lines of the same size.
    sub = ["rest", "place", "size"]
    top = own.where("place > 0").groupBy(*sub).agg(F.min(F.struct("first", *LINE)).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    replaced = own.join(top, sub).where("top.first < first").select(*LINE, "top.h1", "top.h2", "top.first").toDF("h1", "h2", "o1", "o2", "ofirst")
    # A word put in: a longer line's rest is the shorter line itself; whichever is later goes.
    whole = own.where("place = 0").select("rest", (F.col("size") + 1).alias("size"), F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("ofirst"))
    put = own.where("place > 0").join(whole, ["rest", "size"]).select(*LINE, "first", "o1", "o2", "ofirst")
    longer = put.where("ofirst < first").select(*LINE, "o1", "o2", "ofirst")
    shorter = put.where("first < ofirst").select(F.col("o1").alias("h1"), F.col("o2").alias("h2"), F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("ofirst"))
    pairs = replaced.unionByName(longer).unionByName(shorter).groupBy(*LINE).agg(F.min(F.struct("ofirst", "o1", "o2")).alias("o")).select(*LINE, "o.o1", "o.o2")
    later, earlier = lines.select(*LINE, "w"), lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("w").alias("ow"))
    out = ws.cut(pairs.join(later, LINE).join(earlier, ["o1", "o2"]).where(within_one_edit(F.col("w"), F.col("ow"))).select(*LINE).distinct())
    ws.drop(own, some, lines)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with later copies of lines left out, and n_lines and n_dropped (names: `counts`)."""
    ws = Workspace(docs.sparkSession, "lines")
    key1, key2, gaps = unused(docs, "k1", "k2", "drops")
    keyed = docs.withColumns({key1: F.xxhash64(id_col, text_col), key2: F.xxhash64(F.lit(5), id_col, text_col)})
    slim = keyed.select(named(key1).alias("k1"), named(key2).alias("k2"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    seen = ws.cut(occurrences(slim, min_words, near_words))
    place = F.struct(F.col("_id").alias("id"), "k1", "k2", "pos")
    distinct = ws.cut(seen.groupBy(*LINE).agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("halves").alias("halves")))
    near = near_lines(distinct.where(F.size("halves") > 0), slim, ws)
    marked = distinct.select(*LINE, "first", "n").join(near.withColumn("near", F.lit(True)), LINE, "left")
    dupes = marked.where("n > 1 OR near").select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = seen.select("k1", "k2", "_id", "pos", *LINE).join(dupes, LINE).where(F.col("near") | (place != F.col("first")))
    drops = ws.cut(gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("drops")))
    ws.drop(seen, distinct, near)

    text, drop = F.col(text_col), named(gaps)
    ls = F.split(text, "\n", -1)

    def rest(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    joined = keyed.join(drops.toDF(key1, key2, gaps), [key1, key2], "left")
    rebuilt = F.when(drop.isNull() | text.isNull(), text).otherwise(let(ls, rest))
    n_lines, n_dropped = F.when(text.isNull(), 0).otherwise(F.size(ls)).cast("bigint"), F.coalesce(F.size(drop), F.lit(0)).cast("bigint")
    kept = [rebuilt.alias(c) if c == text_col else named(c) for c in docs.columns if c.lower() not in counts]
    return joined.select(*kept, n_lines.alias(counts[0]), n_dropped.alias(counts[1]))
