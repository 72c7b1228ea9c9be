"""Redaction: detectors with checksums, overlap resolution, masks and tokens, leak scan.

A document is a number of fields (doc_id, field, text); a table without `field` has one field a document. Spans are found and
resolved field by field; then every surface found in a document goes from all of its fields: surfaces and the fields' runs of
words are joined by hashes of their words, so that no pattern is tried for each surface and row.

Nulls and extremes: a null text has no spans and stays null; an empty table gives empty results; texts and fields of any
length or number are read whole, in time that grows with them; repeated documents should have ids of their own, as
fields of one id are one document; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import cut, in_blocks, let, running_sums, runs
from inkwell.sources.workspace import Workspace

B = r"(?<![A-Za-z0-9_])"
E = r"(?![A-Za-z0-9_])"
DATE = r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})"
NAME = r"[A-Z][a-z]+"
#: Routing keys of postcodes (fixed values).
ROUTING = tuple("D02 D04 D06 D08 A65 A75 A82 A94 T12 T23 V94 H91 K45 N39 F12 F23 F26 F28 F31 F42 F45 F52 F56 F91 F92 F93 F94 P12 P17 P24 P25 P31 P32 P36 P43 P47 P51 P56 P61 P67 P72 P75 P81 P85 R14 R32 R35 R42 R45 R51 R93 W12 W23 W34 W91 X35 X42 Y14 Y21 Y25 Y34 Y35".split())
#: Names to find where no lists are given by `read_names` (fixed values). A surname with an apostrophe is looked up without it and so never found.
FIRST_NAMES = tuple("liam mary sean aoife ciara patrick niamh conor emma oisin siobhan cian orla declan fiona brian sinead eoin aine padraig".split())
SURNAMES = tuple("murphy kelly o'brien ryan walsh o'sullivan o'connor byrne o'neill mccarthy doyle lynch o'regan kennedy quinn daly burke collins gallagher".split())
#: Words that end a street's name (fixed values).
STREETS = "Road|Street|Avenue|Lane|Drive|Park|Close|Court|Way|Place|Square|Terrace|Crescent|Grove|Green|Estate|Downs|Heights|Manor|View|Walk|Row|Rise|Hill|Gardens|Mews|Wood|Woods|Vale|Meadows|Lawn|Lawns|Quay|Pier|Strand|Boulevard|Bypass|Parkway|Nook|Village|Gate|Bridge|Cottages|Centre|Center"


# Parts of addresses: a capitalised word, a house line, a street line, a break between lines, a line that looks like one.
W = r"[A-Z][A-Za-z'’\-]+"
HOUSE = rf"\d{{1,4}}[A-Z]?\s+{W}(?:\s+{W}){{0,5}}(?:\s+(?:{STREETS}))?"
STREET = rf"(?:{W}(?:\s+{W}){{0,5}}\s+)?(?:{STREETS})(?:\s+{W}){{0,4}}"
TITLED = rf"(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+)?{W}\s+{W}"
BREAK = r"[^\S\n]*\n\s*"
LINE = rf"(?:\d{{1,4}}[A-Z]?[^\S\n]+[^\n]*?|(?>[^\n]*?{B}(?i:{STREETS}){E})[^\n]*?)"


def person(first_names: tuple[str, ...], surnames: tuple[str, ...]) -> str:
    """A line with a title, or of a known first name and surname."""
    words = lambda names: "|".join(n for n in names if n.isalpha())
    known = rf"|(?=[A-Z][a-z]+\s+[A-Z])(?i:{words(first_names)})[^\S\n]+(?i:{words(surnames)})"
    return rf"(?:(?i:Mr|Mrs|Ms|Dr|Prof)\.?[^\S\n]+[^\n]*{known if words(first_names) and words(surnames) else ''})"


POSTCODE = rf"{B}(?i:(?:{'|'.join(ROUTING)})[A-Z0-9]?\s?[A-Z0-9]{{4}}){E}"
#: Categories with their tier, pattern and captured group (fixed values), in order of detection.
PATTERNS = (
    ("ppsn", 1, rf"(?i){B}\d{{7}}[A-W][AHWTX]?{E}", 0),
    ("iban", 1, rf"(?i){B}[A-Z]{{2}}\d{{2}}[A-Z0-9 ]{{11,34}}{E}", 0),
    ("card", 1, rf"{B}(?:\d[ -]*?){{13,19}}{E}", 0),
    ("vat", 1, rf"(?i){B}IE\d{{7}}[A-Z]{{1,2}}{E}", 0),
    ("eircode", 2, rf"(?i){B}[AC-FHKNPRTV-Y]\d{{2}}[A-Z0-9]?\s?[A-Z0-9]{{4}}{E}", 0),
    ("email", 2, rf"{B}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{E}", 0),
    ("phone", 2, rf"\+353[\s\-]?\d{{2}}[\s\-]?\d{{3}}[\s\-]?\d{{4}}{E}", 0),
    ("phone", 2, rf"{B}0[1-9]\d{{1,2}}[\s\-]?\d{{3,4}}[\s\-]?\d{{3,4}}{E}", 0),
    ("dob", 2, rf"(?i)(?:DOB|D\.O\.B|date of birth|born)\s*[:\-]?\s*({DATE})", 1),
    ("account", 2, rf"(?i)(?:account|acc(?:ount)?\s*no|sort\s*code|BIC).{{0,40}}?(\d{{2}}-\d{{2}}-\d{{2}}|{B}\d{{8}}{E})", 1),
    ("person", 3, rf"{B}(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+({NAME}(?:\s+{NAME})?){E}", 1),
    ("person", 3, rf"{B}Dear\s+({NAME}){E}", 1),
    ("person", 3, rf"{B}(?:From|To|Cc):\s*({NAME}(?:\s+{NAME})?){E}", 1),
    ("name", 3, rf"{B}[A-Z][a-z]{{2,}}\s+(?:[A-Z]['’][a-z]{{2,}}|[A-Z][a-z]{{2,}}){E}", 0),
    ("address", 3, rf"{B}{HOUSE}{BREAK}{STREET}{E}", 0),
    ("address", 3, rf"{B}\d{{1,4}}[A-Z]?\s+{W}(?:\s+{W}){{0,5}}\s+(?:{STREETS}){E}", 0),
    ("address", 3, rf"{B}(?:\d{{1,4}}[A-Z]?\s+)?{W}(?:\s+{W}){{0,5}}\s+(?:{STREETS})(?:\s+{W}){{0,4}}{E}", 0),
    ("address", 3, rf"(?m)(?:^|\n)\s*+{TITLED}{BREAK}{HOUSE}{BREAK}{STREET}{E}", 0),
    ("address", 3, rf"(?m)(?:^|\n)\s*+{TITLED}{BREAK}{HOUSE}{E}", 0),
    ("address", 3, rf"(?m)^[^\S\n]*+((?:{person(FIRST_NAMES, SURNAMES)}{BREAK})?(?:{LINE}{BREAK}){{0,2}}{LINE})(?=\s*{POSTCODE})", 1),
)


def patterns(first_names: tuple[str, ...], surnames: tuple[str, ...]) -> tuple[tuple[str, int, str, int], ...]:
    """The categories' patterns with other names to find."""
    return tuple((c, t, p.replace(person(FIRST_NAMES, SURNAMES), person(first_names, surnames)), g) for c, t, p, g in PATTERNS)


#: What a text must hold for a pattern to match: strings of which one is enough, or a pattern after other hints.
HINTS = {
    "digit": r"[0-9]",
    "at": ("@",),
    "abroad": ("+353",),
    "title": ("Mr", "Ms", "Dr", "Prof"),
    "dear": ("Dear",),
    "header": ("From:", "To:", "Cc:"),
    "capitals": r"[A-Z][A-Za-z'’\-]+\s+[A-Z]",
    "street": rf"{B}(?=[A-Z])(?:{STREETS}){E}",
    "number": r"\n\s*+\d",
    "postcode": POSTCODE.replace(B, rf"{B}(?=[A-Za-z]\d)", 1),
}
#: The hints of each of PATTERNS, cheap ones first: all of them must hold, so most texts are read once or twice for all patterns.
#: Every street line has two capitalised words apart by white space; every house, date and number a digit.
NEEDED = (
    ("digit",), ("digit",), ("digit",), ("digit",), ("digit",), ("at",), ("abroad",), ("digit",), ("digit",), ("digit",), ("title",), ("dear",), ("header",), ("capitals",),
    ("digit", "capitals", "street"), ("digit", "capitals", "street"), ("capitals", "street"), ("digit", "number", "capitals", "street"), ("digit", "number"), ("digit", "postcode"),
)
LABELS = {"ppsn": "PPSN", "iban": "IBAN", "card": "CARD", "vat": "VAT", "eircode": "EIRCODE", "email": "EMAIL", "phone": "PHONE", "dob": "DOB", "account": "ACCOUNT", "person": "PERSON", "address": "ADDRESS"}
MASK = "XXXXXXXXX"
SPAN = "array<struct<start:int,back:int,tier:int,category:string,surface:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def ppsn_valid(x: Column) -> Column:
    """Weights 8 to 2 over seven digits; the remainder by 23 names the letter."""
    total = sum((F.substr(x, F.lit(i + 1), F.lit(1)).cast("int") * (8 - i) for i in range(7)), F.lit(0))
    return F.substr(F.lit("WABCDEFGHIJKLMNOPQRSTUV"), total % 23 + 1, F.lit(1)) == F.upper(F.substr(x, F.lit(8), F.lit(1)))


def iban_valid(x: Column) -> Column:
    bare = F.upper(F.regexp_replace(x, r"\s+", ""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(n < 10, acc * 10 + n).otherwise(acc * 100 + n) % 97

    return F.length(bare).between(15, 34) & (F.aggregate(F.regexp_extract_all(turned, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), step) == 1)


def eircode_valid(x: Column, keys: tuple[str, ...]) -> Column:
    return F.left(F.upper(F.regexp_replace(x, r"\s+", "")), F.lit(3)).isin(*keys)


def read_names(spark: SparkSession, path: str, limit: int = 20_000) -> tuple[str, ...]:
    """A list of names from a file, one a line, for `detect`; comments and blank lines are skipped, a longer list refused."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("n")).where("n <> '' AND NOT startswith(n, '#')").distinct().orderBy("n").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} names in {path}")
    return tuple(r["n"] for r in rows)


def known_name(x: Column, first_names: tuple[str, ...], surnames: tuple[str, ...]) -> Column:
    parts = F.split(F.lower(x), r"\s+")
    return parts[0].isin(*first_names) & F.regexp_replace(parts[1], "['’]", "").isin(*surnames)


def valid(category: str, x: Column, names: tuple[tuple[str, ...], tuple[str, ...]] = (FIRST_NAMES, SURNAMES)) -> Column:
    checks = {
        "ppsn": lambda: ppsn_valid(x),
        "iban": lambda: iban_valid(x),
        "card": lambda: F.length(digits(x)).between(13, 19) & F.call_function("luhn_check", digits(x)),
        "eircode": lambda: eircode_valid(x, ROUTING),
        "name": lambda: known_name(x, *names),
        "phone": lambda: F.length(digits(x)).between(9, 13),
    }
    return checks.get(category, lambda: F.lit(True))()


#: Hints that are only looked for where others hold.
AFTER = {"street": ("capitals",), "number": ("digit",), "postcode": ("digit",)}


def holds(text: Column, hint: str | tuple[str, ...]) -> Column:
    """Whether a text holds a pattern, or one of several strings."""
    return text.rlike(hint) if isinstance(hint, str) else reduce(or_, (text.contains(x) for x in hint))


def spans_of(text: Column, category: str, tier: int, pattern: str, group: int, names: tuple[tuple[str, ...], tuple[str, ...]], needed: Column) -> Column:
    """Spans in code points: a match starts after all pieces and matches before it; a group is found inside its match. needed:
    whether the text has what every match needs."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(matches.alias("m"), groups.alias("g"), F.slice(pieces, F.lit(1), F.size(matches)).alias("p"))

    def placed(rows: Column) -> Column:
        size = lambda x: (F.length(x["p"]) + F.length(x["m"])).cast("bigint")

        def span(x: Column, at: Column) -> Column:
            start = (at + size(x)).cast("int") - F.length(x["g"])
            return F.struct(start.alias("start"), (-F.length(x["g"])).alias("back"), F.lit(tier).alias("tier"), F.lit("person" if category == "name" else category).alias("category"), x["g"].alias("surface"))

        return let(running_sums(F.transform(rows, size)), lambda at: F.transform(rows, lambda x, i: span(x, F.get(at, i))))

    out = let(zipped, placed)
    return F.when(needed & text.rlike(pattern), F.filter(out, lambda s: valid(category, s["surface"], names))).otherwise(F.array().cast(SPAN))


def fields_of(prepared: DataFrame) -> DataFrame:
    """doc_id, field, text of prepared documents (text, blocks): the texts of the blocks, or the whole text without any."""
    texts = F.filter(F.transform("blocks", lambda x: x["text"]), lambda t: t != "")
    return prepared.select("doc_id", F.posexplode(F.when(F.size("blocks") > 0, texts).otherwise(F.array("text"))).alias("field", "text"))


def detect(fields: DataFrame, categories: tuple[str, ...] | None = None, first_names: tuple[str, ...] = FIRST_NAMES, surnames: tuple[str, ...] = SURNAMES) -> DataFrame:
    """fields (doc_id, text and, if they have it, field) with `spans`: all confirmed spans by start, longer first."""
    wanted = [(p, n) for p, n in zip(patterns(first_names, surnames), NEEDED, strict=True) if categories is None or p[0] in categories]
    #: Each hint is looked for once, before all patterns: first those that stand alone, then those that follow others.
    used = {h for _, n in wanted for h in n}
    known = lambda h: F.col(f"_hint_{h}")
    alone = [h for h in HINTS if h in used and h not in AFTER]
    rows = fields.select(*own_of(fields), "text", *(holds(F.col("text"), HINTS[h]).alias(f"_hint_{h}") for h in alone))
    rows = rows.withColumns({f"_hint_{h}": reduce(and_, map(known, AFTER[h])) & holds(F.col("text"), HINTS[h]) for h in AFTER if h in used})
    found = [spans_of(F.col("text"), *p, (first_names, surnames), reduce(and_, map(known, n))) for p, n in wanted]
    return rows.select(*own_of(fields), "text", F.sort_array(F.concat(*found)).alias("spans"))


def own_of(fields: DataFrame) -> list[str]:
    return ["doc_id", "field"] if "field" in fields.columns else ["doc_id"]


def end_of(s: Column) -> Column:
    return s["start"] - s["back"]


def resolve(found: DataFrame) -> DataFrame:
    """One of overlapping spans: a new one replaces the first it overlaps if of a stricter tier or longer, else it goes.

    Only spans of a run are held against each other.
    """
    none = F.array().cast(SPAN)

    def step(acc: Column, s: Column) -> Column:
        hits = F.transform(acc, lambda k: (k["start"] < end_of(s)) & (s["start"] < end_of(k)))
        at = F.array_position(hits, True).cast("int")
        old = F.get(acc, at - 1)
        better = (s["tier"] < old["tier"]) | ((s["tier"] == old["tier"]) & (s["back"] < old["back"]))
        swapped = F.transform(acc, lambda k, i: F.when(i == at - 1, s).otherwise(k))
        return F.when(at == 0, F.concat(acc, F.array(s))).when(better, swapped).otherwise(acc)

    fold = lambda run: F.when(F.size(run) < 2, run).otherwise(F.aggregate(run, none, step))
    resolved = F.sort_array(F.flatten(F.transform(runs(F.col("spans"), lambda s: s["start"], end_of), fold)))
    return found.withColumn("spans", F.when(F.size("spans") > 1, resolved).otherwise(F.col("spans")))


def spans(found: DataFrame) -> DataFrame:
    """doc_id, field if there is one, start, length, category, tier, surface: one row a span."""
    #: An inner explode would make Spark look for empty arrays first, by computing them twice.
    rows = found.select(*own_of(found), F.explode_outer("spans").alias("s")).where("s IS NOT NULL")
    return rows.select(*own_of(found), "s.start", (-F.col("s.back")).alias("length"), "s.category", "s.tier", "s.surface")


def surface_key(surface: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(surface), r"\s+", " "))


def with_field(found: DataFrame) -> DataFrame:
    return found if "field" in found.columns else found.withColumn("field", F.lit(0))


def token_map(found: DataFrame) -> DataFrame:
    """doc_id, category, key, surface, token: tokens numbered by label within a document in order of allocation.

    The spans of the first field come first, the last of them before the others; then surfaces of the other fields, longer ones
    first; of surfaces that differ in category only, the later ones last.
    """
    rows = spans(with_field(found)).withColumn("key", surface_key(F.col("surface")))
    firsts = with_field(found).where("text <> ''").groupBy("doc_id").agg(F.min("field").alias("first"))
    keyed = rows.join(firsts, "doc_id").groupBy("doc_id", "category", "key").agg(
        F.max(F.when(F.col("field") == F.col("first"), F.col("start"))).alias("last"),
        F.min(F.struct("field", "start")).alias("seen"),
        F.max_by("surface", F.struct((-F.col("field")).alias("f"), "start")).alias("surface"),
    )
    again = F.row_number().over(Window.partitionBy("doc_id", F.lower("surface")).orderBy("seen")) > 1
    labels = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    turn = F.when(F.col("last").isNotNull(), 0).when(F.col("again"), 2).otherwise(1)
    number = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy(turn, F.desc("last"), F.when(turn == 1, -F.length("surface")), "seen", "key"))
    return keyed.withColumn("again", again).select("doc_id", "category", "key", "surface", F.concat(F.lit("["), labels[F.col("category")], F.lit("-"), number, F.lit("]")).alias("token"))


# -- every surface of a document in all of its fields ---------------------------------------------------------------------

WORD = r"\p{L}\p{N}"
EDGE = rf"(?<=[{WORD}])(?=[^{WORD}])|(?<=[^{WORD}])(?=[{WORD}])"
ITEM = "array<struct<start:bigint,end:bigint,turn:int,back:bigint,key:string,put:string>>"


def surfaces(found: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, key, category, surface, n, words, lead, trail: the distinct surfaces of each document, upper and lower case alike.

    words: a hash of the surface from its first word to its last, n of them; lead and trail: what stands around these.
    """
    key = F.lower("surface") if key is None else key
    one = spans(with_field(found)).groupBy("doc_id", key.alias("key")).agg(F.min_by(F.struct("surface", "category"), F.struct("field", "start")).alias("s"))
    core = F.regexp_replace("key", rf"^[^{WORD}]+|[^{WORD}]+$", "")
    return one.select(
        "doc_id", "key", "s.category", "s.surface", F.regexp_count(core, F.lit(rf"[{WORD}]+")).alias("n"), F.xxhash64(core).alias("words"),
        F.regexp_extract("key", rf"^([^{WORD}]*)", 1).alias("lead"), F.regexp_extract("key", rf"([^{WORD}]*)$", 1).alias("trail"),
    ).where("n > 0")


def runs_of_words(fields: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, field, n, words, start, length, before, after, opens, closes: every run of n words, for the n a document's
    surfaces have (sizes: doc_id, sizes); before and after: what stands between it and the next word."""
    text = F.col("text")

    def runs(parts: Column) -> Column:
        def at(starts: Column) -> Column:
            def run(j: Column, n: Column) -> Column:
                core = F.array_join(F.slice(parts, j + 1, 2 * n - 1), "")
                before, after = F.when(j > 0, F.get(parts, j - 1)).otherwise(""), F.coalesce(F.get(parts, j + 2 * n - 1), F.lit(""))
                return F.struct(
                    n.alias("n"), F.xxhash64(F.lower(core)).alias("words"), F.get(starts, j).alias("start"), F.length(core).cast("bigint").alias("length"), before.alias("before"), after.alias("after"),
                    (j < 2).alias("opens"), (j + 2 * n >= F.size(parts)).alias("closes"),
                )

            words = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda j: F.get(parts, j).rlike(rf"^[{WORD}]"))
            fits = lambda j: F.filter("sizes", lambda n: j + 2 * n - 2 < F.size(parts))
            return F.flatten(F.transform(words, lambda j: F.transform(fits(j), lambda n: run(j, n))))

        return let(running_sums(F.transform(parts, lambda x: F.length(x).cast("bigint"))), at)

    rows = fields.join(sizes, "doc_id").where("text <> ''").select("doc_id", "field", F.explode_outer(let(F.split(text, EDGE, -1), runs)).alias("r"))
    return rows.where("r IS NOT NULL").select("doc_id", "field", "r.*")


def occurrences(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, field, start, end and the columns of wanted (surfaces): where surfaces stand as whole words."""
    sizes = wanted.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("n").cast("int"))).alias("sizes"))
    met = runs_of_words(fields, sizes).join(wanted, ["doc_id", "n", "words"])
    left = (F.col("lead") == "") | (F.endswith("before", "lead") & (F.col("opens") | (F.length("before") > F.length("lead"))))
    right = (F.col("trail") == "") | (F.startswith("after", "trail") & (F.col("closes") | (F.length("after") > F.length("trail"))))
    start = F.col("start") - F.length("lead")
    return met.where(left & right).select("doc_id", "field", start.alias("start"), (F.col("start") + F.col("length") + F.length("trail")).alias("end"), *(c for c in wanted.columns if c not in ("doc_id", "n", "words", "lead", "trail")))


def chosen(items: Column) -> Column:
    """Of overlapping items the one with the lowest turn, then the longest, then by key and place; items sorted by start."""
    none = F.array().cast(ITEM)

    def best(run: Column) -> Column:
        ranked = F.array_sort(F.transform(run, lambda x: F.struct(x["turn"].alias("turn"), x["back"].alias("back"), x["key"].alias("key"), x["start"].alias("start"), x.alias("x"))))
        keep = lambda acc, r: F.when(F.exists(acc, lambda k: (k["start"] < r["x"]["end"]) & (r["x"]["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(r["x"])))
        return F.when(F.size(run) < 2, run).otherwise(F.sort_array(F.aggregate(ranked, none, keep)))

    return F.when(F.size(items) < 2, items).otherwise(F.flatten(F.transform(runs(items, lambda x: x["start"], lambda x: x["end"]), best)))


def put_in(text: Column, items: Column) -> Column:
    """A text with items, sorted and apart, replaced by what is put for them."""

    def whole(xs: Column, blocks: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(xs, i - 1)["end"]).otherwise(F.lit(0).cast("bigint"))
        parts = F.transform(xs, lambda x, i: F.concat(cut(blocks, before(i), x["start"] - before(i)), x["put"]))
        return F.concat(F.array_join(parts, ""), cut(blocks, before(F.size(xs)), F.length(text) - before(F.size(xs))))

    return F.when(F.size(items) > 0, let(items, lambda xs: let(in_blocks(text), lambda blocks: whole(xs, blocks)))).otherwise(text)


def item(start: Column, end: Column, turn: int, key: Column, put: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(turn).alias("turn"), (start - end).cast("bigint").alias("back"), key.alias("key"), put.alias("put"))


def apply_spans(found: DataFrame, tokens: DataFrame | None = None, everywhere: bool = True) -> DataFrame:
    """doc_id, field if there is one, text, spans: resolved spans replaced by a mask, or by the tokens that token_map gives for
    the same spans, and so, if `everywhere`, every surface of a document wherever it stands as a word in any field.

    A field's own spans come first, then longer surfaces; what has been replaced isn't looked at again. found: a table,
    or a plan that is cheap to compute twice (`redact` writes it).
    """
    every = with_field(found)
    label = lambda category, key: F.concat_ws(" ", category, key)
    put_for = lambda category, surface: F.coalesce(F.element_at("_tokens", label(category, surface_key(surface))), F.lit(MASK))
    if tokens is None:
        maps = None
        rows = every.withColumn("_tokens", F.lit(None).cast("map<string,string>"))
    else:
        maps = tokens.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(label(F.col("category"), F.col("key")), "token"))).alias("_tokens"))
        rows = every.join(maps, "doc_id", "left")
    own = F.transform("spans", lambda s: item(s["start"], end_of(s), 0, s["surface"], put_for(s["category"], s["surface"])))
    if everywhere:
        wanted = surfaces(every).select("doc_id", "key", "category", "surface", "n", "words", "lead", "trail")
        met = occurrences(every.select("doc_id", "field", "text"), wanted)
        met = met.withColumn("_tokens", F.lit(None).cast("map<string,string>")) if maps is None else met.join(maps, "doc_id", "left")
        more = met.groupBy("doc_id", "field").agg(F.collect_list(item(F.col("start"), F.col("end"), 1, F.col("key"), put_for(F.col("category"), F.col("surface")))).alias("_more"))
        rows = rows.join(more, ["doc_id", "field"], "left")
        own = F.concat(own, F.coalesce("_more", F.array().cast(ITEM)))
    items = rows.withColumn("_items", chosen(F.array_sort(own)))
    return items.select(*own_of(found), put_in(F.col("text"), F.col("_items")).alias("text"), "spans")


def leaks(redacted: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, leaks, leaked: how many surfaces of three characters or more, found in any field of a document, its redacted fields
    still hold as words, and which. found: what was redacted, if `redacted` has no spans."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))
    source = redacted if found is None else found
    wanted = surfaces(source, plain(F.col("surface"))).where(F.length("key") >= 3)
    left = occurrences(with_field(redacted).select("doc_id", "field", plain(F.col("text")).alias("text")), wanted)
    counted = left.groupBy("doc_id").agg(F.count_distinct("key").alias("n"), F.sort_array(F.collect_set("key")).alias("leaked"))
    every = redacted.select("doc_id").distinct()
    return every.join(counted, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("int").alias("leaks"), F.coalesce("leaked", F.array().cast("array<string>")).alias("leaked"))


def redact(fields: DataFrame, mode: str = "mask", categories: tuple[str, ...] | None = None, first_names: tuple[str, ...] = FIRST_NAMES, surnames: tuple[str, ...] = SURNAMES) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Whole documents: (doc_id, field, text, spans, leaks), what was found, and the tokens (None under a mask).

    fields: doc_id, text and, if documents have several, field. mode: `mask` or `token`. A document of which a surface is left
    isn't released: its texts are null and `leaks` tells how many are left. What was found, and the result, are written once.
    """
    if mode not in ("mask", "token"):
        raise ValueError(f"mode is mask or token, not {mode}")
    ws = Workspace(fields.sparkSession, "redact")
    found = ws.cut(resolve(detect(fields, categories, first_names, surnames)))
    tokens = token_map(found) if mode == "token" else None
    done = ws.cut(apply_spans(found, tokens))
    return released(done), found, tokens


def released(redacted: DataFrame) -> DataFrame:
    """The redacted fields with their documents' `leaks`; texts of documents with leaks are null."""
    out = redacted.join(leaks(redacted).select("doc_id", "leaks"), "doc_id", "left")
    return out.select(*own_of(redacted), F.when(F.col("leaks") == 0, F.col("text")).alias("text"), "spans", "leaks")


def stats(found: DataFrame) -> DataFrame:
    """category, tier, n over all documents, with totals by category, by tier and of all (null: all)."""
    return spans(found).groupingSets([["category", "tier"], ["category"], ["tier"], []], "category", "tier").agg(F.count("*").alias("n"))
