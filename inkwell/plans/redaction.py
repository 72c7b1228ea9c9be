"""Queries of redaction over whole documents and over their lines as fields, with their SQL twins.

DuckDB's patterns have no look-around: a word's edge stands for it, and the twin of the address before a postcode takes the
postcode along and cuts it off. Repeats are found by splitting each field at each surface.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from inkwell.functions.text import LINE_BREAK
from inkwell.operators import redact
from inkwell.sources.workspace import Workspace

from .catalogue import DOCS, docs, query


def lines_as_fields(spark, sf_dir):
    """doc_id, field, text: the lines of documents."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode_outer(F.split("text", LINE_BREAK, -1)).alias("field", "text"))


# -- SQL ----------------------------------------------------------------------------------------------------------------

_KNOWN = "(?:" + "|".join(n.capitalize() for n in redact.FIRST_NAMES) + r")[^\S\n]+(?:" + "|".join(f"{n[0].upper()}(?i:{n[1:]})" for n in redact.SURNAMES if n.isalpha()) + ")"
_PERSON = rf"(?:(?i:Mr|Mrs|Ms|Dr|Prof)\.?[^\S\n]+[^\n]*|{_KNOWN})"
_POSTCODE = rf"\b(?i:(?:{'|'.join(redact.ROUTING)})[A-Z0-9]?\s?[A-Z0-9]{{4}})\b"


def plain(category: str, pattern: str) -> str:
    """A pattern without look-around."""
    if category == "email":
        pattern = pattern.removeprefix(redact.B)
    if category == "iban":
        return r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9 ]{10,33}(?:[A-Z0-9]\b| \B)"
    pattern = pattern.replace(redact.person(redact.FIRST_NAMES, redact.SURNAMES), _PERSON).replace(rf"(?=\s*{redact.POSTCODE})", rf"\s*{_POSTCODE}")
    return pattern.replace(redact.B, r"\b").replace(redact.E, r"\b").replace("*+", "*").replace("(?>", "(?:").replace("'", "''")


_DIGITS = "regexp_replace(x, '\\D', '', 'g')"
_BARE = "upper(regexp_replace(x, '\\s+', '', 'g'))"
_TURNED = f"array_to_string(list_transform(string_split(substr({_BARE}, 5) || left({_BARE}, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) WHEN c BETWEEN '0' AND '9' THEN c ELSE '' END), '')"
_QUOTED = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in names)
VALID = {
    "ppsn": "substr('WABCDEFGHIJKLMNOPQRSTUV', CAST(list_sum([CAST(x[i] AS INTEGER) * (9 - i) for i in range(1, 8)]) % 23 AS BIGINT) + 1, 1) = upper(x[8])",
    "iban": f"length({_BARE}) BETWEEN 15 AND 34 AND list_reduce([CAST(c AS INTEGER) for c in string_split({_TURNED}, '')], lambda a, c: (a * 10 + c) % 97) = 1",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN c >= '5' THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0",
    "eircode": f"left({_BARE}, 3) IN ({_QUOTED(redact.ROUTING)})",
    "name": f"regexp_split_to_array(lower(x), '\\s+')[1] IN ({_QUOTED(redact.FIRST_NAMES)}) AND regexp_replace(regexp_split_to_array(lower(x), '\\s+')[2], '[''’]', '') IN ({_QUOTED(redact.SURNAMES)})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 13",
}


def found(fields: str) -> str:
    """CTEs from `fields` (doc_id, field, text) to `spans` (doc_id, field, start, back, tier, category, surface), resolved."""
    parts = []
    for category, tier, pattern, group in redact.PATTERNS:
        p, valid = plain(category, pattern), VALID.get(category, "true")
        tail = f"length(regexp_extract(m, '(\\s*{_POSTCODE})$', 1))" if r"(?=\s*" in pattern else "0"
        name = "person" if category == "name" else category
        parts.append(f"""SELECT doc_id, field, stop - {tail} - length(x) AS start, {tier} AS tier, '{name}' AS category, x FROM (SELECT *, CAST(sum(length(m) + length(g)) OVER (PARTITION BY doc_id, field ORDER BY i) AS INTEGER) AS stop
            FROM (SELECT doc_id, field, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(xs) AS x, unnest(list_slice(gs, 1, len(ms))) AS g
            FROM (SELECT doc_id, field, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS xs, regexp_split_to_array(text, '{p}') AS gs FROM {fields} WHERE regexp_matches(text, '{p}')))) WHERE {valid}""")
    union = "\n UNION ALL ".join(parts)
    return f"""every AS MATERIALIZED ({union}),
        sorted AS (SELECT doc_id, field, list([{{'start': start, 'back': -length(x), 'tier': tier, 'category': category, 'surface': x}}] ORDER BY start, -length(x), tier, category, x) AS ss FROM every GROUP BY doc_id, field),
        folded AS (SELECT doc_id, field, list_reduce(ss, lambda a, s: CASE
            WHEN len(list_filter(a, lambda k: k.start < s[1].start - s[1].back AND s[1].start < k.start - k.back)) = 0 THEN list_concat(a, s)
            WHEN s[1].tier < list_filter(a, lambda k: k.start < s[1].start - s[1].back AND s[1].start < k.start - k.back)[1].tier
              OR (s[1].tier = list_filter(a, lambda k: k.start < s[1].start - s[1].back AND s[1].start < k.start - k.back)[1].tier AND s[1].back < list_filter(a, lambda k: k.start < s[1].start - s[1].back AND s[1].start < k.start - k.back)[1].back)
            THEN list_transform(a, lambda k, i: CASE WHEN i = list_position(list_transform(a, lambda z: z.start < s[1].start - s[1].back AND s[1].start < z.start - z.back), true) THEN s[1] ELSE k END)
            ELSE a END) AS s FROM sorted),
        spans AS MATERIALIZED (SELECT doc_id, field, u.start, u.back, u.tier, u.category, u.surface FROM (SELECT doc_id, field, unnest(s) AS u FROM folded))"""


KEY = "lower(regexp_replace(trim({0}), '\\s+', ' ', 'g'))"
LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in redact.LABELS.items())
TOKENS = f"""firsts AS (SELECT doc_id, min(field) AS one FROM fields WHERE text <> '' GROUP BY doc_id),
    keyed AS (SELECT doc_id, category, {KEY.format("surface")} AS key, max(start) FILTER (field = one) AS last, min((field, start)) AS seen, arg_max(surface, (-field, start)) AS surface FROM spans JOIN firsts USING (doc_id) GROUP BY ALL),
    turned AS (SELECT *, CASE WHEN last IS NOT NULL THEN 0 WHEN row_number() OVER (PARTITION BY doc_id, lower(surface) ORDER BY seen) > 1 THEN 2 ELSE 1 END AS turn FROM keyed),
    tokens AS (SELECT doc_id, category, key, surface, '[' || CASE category {LABELS} END || '-' || row_number() OVER (PARTITION BY doc_id, category ORDER BY turn, last DESC NULLS LAST, CASE WHEN turn = 1 THEN -length(surface) END NULLS FIRST, seen, key) || ']' AS token FROM turned)"""


def applied(put: str, everywhere: bool = True) -> str:
    """CTEs from `fields` and `spans` to `redacted` (doc_id, field, text). put: SQL of what stands for (doc_id, category, surface)."""
    repeats = f"""UNION ALL SELECT doc_id, field, stop - length(key), stop, 1, key, {put} FROM met WHERE i < n AND (stop = length(key) OR NOT regexp_matches(substr(text, stop - length(key), 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substr(text, stop + 1, 1), '[\\p{{L}}\\p{{N}}]')"""
    return f"""wanted AS MATERIALIZED (SELECT doc_id, lower(surface) AS key, arg_min(surface, (field, start)) AS surface, arg_min(category, (field, start)) AS category FROM spans GROUP BY ALL),
    met AS (SELECT *, CAST(sum(length(piece) + length(key)) OVER (PARTITION BY doc_id, field, key ORDER BY i) AS INTEGER) AS stop FROM (SELECT f.doc_id, f.field, f.text, w.key, w.surface, w.category, unnest(string_split(lower(f.text), w.key)) AS piece, generate_subscripts(string_split(lower(f.text), w.key), 1) AS i, len(string_split(lower(f.text), w.key)) AS n
      FROM fields f JOIN wanted w USING (doc_id) WHERE contains(lower(f.text), w.key))),
    items AS (SELECT doc_id, field, start, start - back AS stop, 0 AS turn, surface AS key, {put} AS put FROM spans {repeats if everywhere else ""}),
    ordered AS (SELECT doc_id, field, list([{{'start': start, 'stop': stop, 'put': put}}] ORDER BY turn, start - stop, key, start) AS xs FROM items GROUP BY doc_id, field),
    kept AS (SELECT doc_id, field, list_sort(list_reduce(xs, lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.start < x[1].stop AND x[1].start < k.stop)) > 0 THEN a ELSE list_concat(a, x) END)) AS xs FROM ordered),
    parts AS (SELECT doc_id, field, i, u.start AS start, u.stop AS stop, u.put AS put, coalesce(lag(u.stop) OVER (PARTITION BY doc_id, field ORDER BY i), 0) AS before FROM (SELECT doc_id, field, unnest(xs) AS u, generate_subscripts(xs, 1) AS i FROM kept)),
    built AS (SELECT p.doc_id, p.field, string_agg(substr(f.text, before + 1, start - before) || put, '' ORDER BY i) AS head, max(stop) AS stop FROM parts p JOIN fields f USING (doc_id, field) GROUP BY ALL),
    redacted AS MATERIALIZED (SELECT f.doc_id, f.field, CASE WHEN head IS NULL THEN f.text ELSE head || substr(f.text, b.stop + 1) END AS text FROM fields f LEFT JOIN built b USING (doc_id, field))"""


WHOLE = f"{DOCS}, fields AS (SELECT doc_id, 0 AS field, text FROM d)"
LINED = f"{DOCS}, fields AS MATERIALIZED (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS field, unnest(ls) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS ls FROM d))"
MASK = f"'{redact.MASK}'"
TOKEN = f"(SELECT any_value(token) FROM tokens t WHERE t.doc_id = {{0}}.doc_id AND t.category = {{0}}.category AND t.key = {KEY.format('{0}.surface')})"
LEAKS = """outs AS (SELECT doc_id, field, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM redacted),
    keys AS (SELECT DISTINCT doc_id, lower(regexp_replace(surface, '\\s+', ' ', 'g')) AS key FROM spans),
    still AS (SELECT doc_id, key, field, piece, i, n, text, CAST(sum(length(piece) + length(key)) OVER (PARTITION BY doc_id, field, key ORDER BY i) AS INTEGER) AS stop FROM (SELECT o.doc_id, k.key, o.field, o.text, unnest(string_split(o.text, k.key)) AS piece, generate_subscripts(string_split(o.text, k.key), 1) AS i, len(string_split(o.text, k.key)) AS n
      FROM outs o JOIN keys k USING (doc_id) WHERE length(k.key) >= 3 AND contains(o.text, k.key))),
    left_ AS (SELECT doc_id, count(DISTINCT key) AS n, string_agg(DISTINCT key, '|' ORDER BY key) AS leaked FROM still WHERE i < n AND (stop = length(key) OR NOT regexp_matches(substr(text, stop - length(key), 1), '[\\p{L}\\p{N}]')) AND NOT regexp_matches(substr(text, stop + 1, 1), '[\\p{L}\\p{N}]') GROUP BY doc_id)"""


# -- queries --------------------------------------------------------------------------------------------------------------


def whole(spark, sf_dir):
    return redact.resolve(redact.detect(docs(spark, sf_dir)))


@query(f"WITH {WHOLE}, {found('fields')} SELECT doc_id, start, -back AS length, category, tier, surface FROM spans")
def redaction_spans(spark, sf_dir):
    return redact.spans(whole(spark, sf_dir))


@query(f"WITH {WHOLE}, {found('fields')} SELECT category, tier, count(*) AS n FROM spans GROUP BY GROUPING SETS ((category, tier), (category), (tier), ())")
def redaction_stats(spark, sf_dir):
    return redact.stats(whole(spark, sf_dir))


@query(f"WITH {WHOLE}, {found('fields')}, {applied(MASK)} SELECT doc_id, text FROM redacted")
def mask_text(spark, sf_dir):
    return redact.redact(docs(spark, sf_dir))[0].select("doc_id", "text")


@query(f"WITH {WHOLE}, {found('fields')}, {TOKENS} SELECT * FROM tokens")
def token_map(spark, sf_dir):
    return redact.token_map(whole(spark, sf_dir))


@query(f"WITH {LINED}, {found('fields')}, {applied(MASK)}, {LEAKS} SELECT r.doc_id, field, text, CAST(0 AS INTEGER) AS leaks FROM redacted r WHERE doc_id NOT IN (SELECT doc_id FROM left_)")
def redacted_fields(spark, sf_dir):
    """The lines of documents, masked: a surface found in one line goes from all."""
    return redact.redact(lines_as_fields(spark, sf_dir))[0].select("doc_id", "field", "text", "leaks")


@query(f"WITH {LINED}, {found('fields')}, {TOKENS}, {re.sub('@PUT FROM (spans|met)', lambda m: TOKEN.format(m[1]) + ' AS put FROM ' + m[1], applied('@PUT').replace('@PUT AS put FROM', '@PUT FROM'))} SELECT doc_id, field, text FROM redacted")
def redacted_tokens(spark, sf_dir):
    """The lines of documents with tokens that are the same in all lines."""
    return redact.redact(lines_as_fields(spark, sf_dir), "token")[0].select("doc_id", "field", "text")


@query(f"WITH {LINED}, {found('fields')}, {applied(MASK, False)}, {LEAKS} SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS leaks, coalesce(leaked, '') AS leaked FROM d LEFT JOIN left_ USING (doc_id)")
def leak_scan(spark, sf_dir):
    """What is left where spans are masked in their own lines only."""
    ws = Workspace(spark, "leaks")
    found = ws.cut(redact.resolve(redact.detect(lines_as_fields(spark, sf_dir))))
    return redact.leaks(ws.cut(redact.apply_spans(found, everywhere=False))).select("doc_id", "leaks", F.array_join("leaked", "|").alias("leaked"))


def _kind(category: str, pattern: str):
    sql = f"WITH {DOCS} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS x FROM d) GROUP BY doc_id"

    def run(spark, sf_dir):
        return redact.spans(redact.detect(docs(spark, sf_dir), (category,))).groupBy("doc_id").agg(F.count("*").alias("n"))

    run.__name__ = f"pii_{category}"
    query(sql)(run)


_kind("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")
_kind("vat", r"(?i)\bIE\d{7}[A-Z]{1,2}\b")
_kind("dob", rf"(?i)(?:DOB|D\.O\.B|date of birth|born)\s*[:\-]?\s*{redact.DATE}")
