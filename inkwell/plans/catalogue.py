"""Named queries over the supplied tables, with their SQL twins.

The supplied documents hold few of the things that the document operators look for, so planted rows (negative ids)
join them in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import blocks, cite, library, normalise, profile, quality, references, stats, summary

from inkwell.sources import index, writers
from inkwell.sources.tables import spread
from inkwell.sources.workspace import Workspace

from . import documents

PLANTED = (
    (-1, "# Annual report\n\nScope of work\n- first item\n* second item\n## 1.1 Method\nText under method, see 10.1000/xyz123 and https://a.ie/b. and [1, 2].\nAGAIN HTTPS://A.IE/B and [1, 2]\n### 2. Results\nThe index increased by 12% to €40 in 2021."),
    (-2, "RUNNING HEAD 1\n1.1 Scope\nBody text wraps over\nthe next line.\n\n12\n\n1.2 Method\n• first bullet\ncontinues here\n* second bullet\nTable 3. Numbers of things\nIntroduction ........ 10\n\n13\n"),
    (-3, "Header line\nText one.\n1 | P a g e\nHeader line\nText two.\n2 | P a g e\nInitials Name Company Title\nBOR Brian O Regan\nABC Anna Byrne Chief\n\nplain end"),
    (-4, "Contact mary.murphy@example.ie or +353 86 123 4567, 021 490 3000. PPSN 1234567T, not 1234567A. IBAN: IE29AIBK93115212345678.\nCard 4111 1111 1111 1111 and 4111111111111112. VAT IE1234567AB. Eircode T12 AB34. DOB: 01/02/1980. Account no 12345678, sort code 90-12-34. Dear Mary, Dr. John Smith met Mary Murphy in Cork."),
    (-5, "Note: first. Note: second. Note: third. Sales rose. Costs were reduced by 15% and therefore 20 sites closed. 0 It ended."),
    (-6, "α=β+γ≤δ±ε×ζ\nCafÃ© Ã¼ber Ã© text\nminimi ses the ses utili sation of things"),
    (-7, ""),
    (-8, "A short lead stands here. It goes on.\n\n1.1 Scope\n• costs were reduced by 12%\n• plain item\n\n1.2 Method\n• costs were reduced by 12%\n• 20 people were hired\n• on 1/2/2020 and 3/4/2021 nothing\n\n1.3 End\n• last item 40%\n"),
    (-9, "one line here\n\nhead a\nhead b\nhead c\nhead d\nhead e\n\n3\n\nA sentence ends.\nfoot\n4\n\nfar from it" + "\n" * 14 + "8\n"),
    (-10, "Plan of Works 2025\nx\n\nPlan of Works\n1 | Page\nbody text\nPlan of Works\nFigure 2: A map of roads\n2 | Page\nmore of the body\nTeam Member Role\n\n1 Anna Lead\n22 Brian Tester\nnot a row here\nPlan of Works\n3 | Page\nend."),
    (-11, "# Report\n## 1. Summary\nfirst words\n\n## 2. Scores\n- 40 points\n## Plain\ntail\n### 3. Deep\n\n#### 3.1 Deeper words\n- a\n## 4. Quality Verdict\n"),
    (-12, "VAT IE7654321A and ie1234567wb; VAT: IE12345678. Born 1 January 1970, DOB 1980-02-03, date of birth: 4/5/90. Sort code 12-34-56. Mail a.b@c.org, x_y@z.co.uk; From: John Byrne, To: Anna. Call 0871234567. IBAN GB82 WEST 1234 5698 7654 32 ok. T23 XY12\n12 Oak Park\nCork Road\n"),
    (-14, "Dear Mary, Dr. John Smith met us.\nLater John Smith left. john smith too; Johnsmith no.\nMail a@b.ie, A@B.IE or aa@b.ie.\nCall +353 86 123 4567 (+353 86 123 4567), not 7+353 86 123 4567.\nMary's card 4111 1111 1111 1111.\nMary Murphy, mary murphy. Born 1 May 1990; 1 may 1990"),
    (-13, "1. Opening words\nbody one\n2. Second part\nlower case follows\n3. Third: a b c\n∑x=α+β≈γ≥δ≠ε\nContents . . . . . 3\nTable 4 - Numbers\nCafé and cafe. CAFÉ!\nsee https://b.ie/x, HTTPS://B.IE/X and [3-5] [3-5]; 10.5555/AbC 10.5555/abc\n"),
)


def values(rows: tuple) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(list(PLANTED), "doc_id bigint, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(planted)


DOCS = f"d AS (SELECT doc_id, text FROM documents UNION ALL SELECT CAST(a AS BIGINT), b FROM (VALUES {values(PLANTED)}) AS p(a, b))"
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
LINES = f"{DOCS}, l AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, trim(ls[pos], {BLANKS}) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS ls FROM d)))"
WORDS = "len(regexp_extract_all(regexp_replace(regexp_replace(text, '^[''-]+', ''), '-+$', ''), '[A-Za-z''-]+'))"



def _words(text: str) -> str:
    return WORDS.replace("text", text)


def _matches(text: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


#: DuckDB's patterns have no possessive repeats, and need none.
SECTION = blocks.SECTION.replace("*+", "*")
TOKENS_OF = "regexp_split_to_array(line, '\\s+')"
HEADER_LINE = f"""(line <> '' AND length(line) <= 70 AND NOT {_matches("line", "[.!?:;,]$", blocks.BULLET, blocks.NUMBERED, SECTION, blocks.LEADER)} AND len({TOKENS_OF}) BETWEEN 3 AND 8
    AND len(list_filter({TOKENS_OF}, lambda t: regexp_matches(t, '^[(\\[]?\\p{{Lu}}'))) >= greatest(3, len({TOKENS_OF}) - 1))"""
ROW_LINE = f"""(line <> '' AND length(line) <= 120 AND NOT {_matches("line", blocks.BULLET, SECTION, blocks.LEADER)} AND len({TOKENS_OF}) >= 3 AND {_matches(f"{TOKENS_OF}[1]", "^\\d{1,3}$", "^\\p{Lu}{2,5}$")})"""

def _is_math(x: str) -> str:
    return f"""(length({x}) BETWEEN 3 AND 600 AND len(regexp_extract_all({x}, '{blocks.MATH}')) >= 5 AND len(regexp_extract_all({x}, '{blocks.MATH}')) / greatest(1, length(regexp_replace({x}, '\\s+', '', 'g'))) >= 0.12
    AND len(list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]+'), lambda t: regexp_full_match(t, '\\p{{L}}{{3,}}'))) <= len(regexp_extract_all({x}, '{blocks.MATH}')))"""


#: Lines with page furniture marked.
MARKED = f"""{LINES},
    m1 AS (SELECT *, {_matches("line", blocks.PAGE_LABEL)} AS label, lower(trim(regexp_replace(regexp_replace(line, '\\d+', '', 'g'), '\\s+', ' ', 'g'), {BLANKS})) AS sig,
      coalesce(lag(line) OVER o, '') = '' OR coalesce(lead(line) OVER o, '') = '' AS alone FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    m2 AS (SELECT *, bool_or(label) OVER (PARTITION BY doc_id) AS labelled, sig <> '' AND count(*) OVER (PARTITION BY doc_id, sig) >= {normalise.REPEATS} AS recurs FROM m1),
    m3 AS (SELECT *, CASE WHEN label THEN 'label' WHEN NOT labelled AND {_matches("line", blocks.PAGE_NUMBER)} AND alone THEN 'number' END AS marker,
      line <> '' AND CASE WHEN labelled THEN NOT recurs ELSE {_matches("line", blocks.BULLET, blocks.NUMBERED, SECTION, "[.!?,;:]$")} OR length(line) > 80 END AS stops FROM m2),
    reach AS (SELECT a.doc_id, a.pos, k.pos AS mark, k.marker FROM m3 a JOIN m3 k ON a.doc_id = k.doc_id AND k.marker IS NOT NULL AND k.pos <> a.pos AND abs(k.pos - a.pos) <= {normalise.REACH} AND (k.pos > a.pos OR k.labelled) WHERE a.line <> '' AND NOT a.stops),
    near AS (SELECT doc_id, pos, mark, marker FROM reach QUALIFY row_number() OVER (PARTITION BY doc_id, pos, mark > pos ORDER BY abs(mark - pos)) = 1),
    walked AS (SELECT n.doc_id, n.pos FROM near n JOIN m3 b ON b.doc_id = n.doc_id AND b.pos BETWEEN least(n.pos, n.mark) AND greatest(n.pos, n.mark) AND b.pos <> n.mark GROUP BY n.doc_id, n.pos, n.mark, n.marker
      HAVING NOT bool_or(b.stops) AND (n.marker = 'label' OR count(*) FILTER (b.line <> '' AND b.marker IS NULL) <= {normalise.LONE})),
    marked AS (SELECT doc_id, pos, line, marker, marker IS NOT NULL OR EXISTS (SELECT 1 FROM walked w WHERE w.doc_id = m3.doc_id AND w.pos = m3.pos) AS dropped FROM m3)"""


def _kinds(source: str, tables: bool) -> str:
    """CTEs from lines (doc_id, pos, line, dropped) to `kinds` (doc_id, pos, line, opens, kind), dropped lines left out."""
    return f"""k1 AS (SELECT *, {f"NOT dropped AND {HEADER_LINE}" if tables else "false"} AS header, {f"NOT dropped AND {ROW_LINE}" if tables else "false"} AS "row" FROM {source}),
    k2 AS (SELECT *, last_value(CASE WHEN line <> '' THEN header END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header_before,
      first_value(CASE WHEN line <> '' THEN line END IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following,
      first_value(CASE WHEN line <> '' THEN "row" END IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS row_after,
      sum(CAST({_matches("line", SECTION)} AND length(line) < 150 AND NOT dropped AS INTEGER)) OVER (PARTITION BY doc_id) >= 2 AS skeleton FROM k1 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    k3 AS (SELECT *, header AND coalesce(row_after, false) AS opens, last_value(CASE WHEN "row" AND coalesce(header_before, false) THEN 1 WHEN line = '' OR (NOT dropped AND NOT "row") THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) = 1 AS inside FROM k2),
    kinds AS (SELECT doc_id, pos, line, opens, CASE WHEN line = '' THEN 'blank' WHEN opens OR ("row" AND coalesce(inside, false)) THEN 'row' WHEN {_matches("line", blocks.LEADER)} THEN 'leader' WHEN {_matches("line", blocks.CAPTION)} THEN 'caption'
      WHEN {_matches("line", SECTION)} AND length(line) < 150 THEN CASE WHEN {_matches("coalesce(following, '')", blocks.LEADER)} THEN 'leader' ELSE 'section' END
      WHEN NOT skeleton AND {_matches("line", blocks.NUMBERED)} AND {_words("line")} BETWEEN 1 AND 12 AND length(line) <= 90 AND NOT {_matches("line", ":\\s+\\S+\\s+\\S+")} AND NOT {_matches("coalesce(following, '')", "^\\p{Ll}")} THEN 'numbered'
      WHEN {_matches("line", blocks.BULLET)} THEN 'bullet' ELSE 'text' END AS kind FROM k3 WHERE NOT dropped),
    b1 AS (SELECT *, sum(CAST(NOT joins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM (SELECT *, kind = 'text' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) IN ('text', 'bullet'), false) AS joins FROM kinds)),
    merged AS (SELECT doc_id, block, min(pos) AS pos, arg_min(kind, pos) AS kind, bool_or(opens) AS opens, trim(string_agg(CASE WHEN kind = 'bullet' THEN regexp_replace(line, '{blocks.BULLET}', '') ELSE line END, ' ' ORDER BY pos), {BLANKS}) AS x FROM b1 WHERE kind NOT IN ('blank', 'leader') GROUP BY doc_id, block),
    named AS (SELECT *, CASE kind WHEN 'caption' THEN 'caption' WHEN 'section' THEN 'heading' WHEN 'numbered' THEN 'heading' WHEN 'bullet' THEN 'list' ELSE 'paragraph' END AS type FROM merged)"""


ALL_LINES = f"{LINES}, every AS (SELECT *, false AS dropped FROM l)"
PARTS = f"""parts AS (SELECT doc_id, pos, 0 AS part, 'note' AS type, '{normalise.TABLE_NOTE}' AS text, CAST(NULL AS INTEGER) AS level, false AS table_row, false AS math_degraded FROM named WHERE x <> '' AND opens
    UNION ALL SELECT doc_id, pos, 1, type, x, CASE WHEN type = 'heading' THEN 2 END, kind = 'row', kind = 'text' AND {_is_math("x")} FROM named WHERE x <> ''
    UNION ALL SELECT doc_id, pos, 2, 'note', '{normalise.MATH_NOTE}', NULL, false, false FROM named WHERE x <> '' AND kind = 'text' AND {_is_math("x")})"""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- blocks -----------------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN instr(text, '#') > 0 AND strlen(substr(text, 1, instr(text, '#') - 1)) < 8192 THEN 'markdown' ELSE 'text' END AS parser FROM d")
def parser_dispatch(spark, sf_dir):
    return blocks.parser_of(docs(spark, sf_dir))


@query(f"""WITH {LINES} SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.') THEN 'heading' ELSE 'paragraph' END AS type,
    CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.') THEN CAST(length(regexp_extract(line, '^(#{{1,6}})', 1)) AS INTEGER) END AS level,
    CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.') THEN regexp_extract(line, '^#{{1,6}}\\s+(.+)', 1) WHEN regexp_matches(line, '^[-*]\\s+') THEN regexp_replace(line, '^[-*]\\s+', '') ELSE line END AS text
    FROM l WHERE line <> ''""")
def md_blocks(spark, sf_dir):
    return blocks.markdown_blocks(docs(spark, sf_dir))


@query(f"""WITH {LINES}, m AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+') AS marked,
    strlen(line) < 80 AND NOT regexp_matches(line, '[.!?]$') AND translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') = line AS cap, regexp_replace(line, '^#+', '') AS rest FROM l WHERE line <> '')
    SELECT doc_id, pos, CASE WHEN marked OR cap THEN 'heading' ELSE 'paragraph' END AS type,
    CASE WHEN marked THEN CAST(length(rest) - length(ltrim(rest, ' ')) AS INTEGER) WHEN cap THEN 2 END AS level,
    CASE WHEN marked THEN regexp_replace(line, '^#+\\s+', '') ELSE line END AS text FROM m""")
def txt_blocks(spark, sf_dir):
    return blocks.text_blocks(docs(spark, sf_dir))


@query(f"""WITH {LINES}, b AS (SELECT doc_id, pos, regexp_matches(line, '^#{{1,6}}\\s+.') AS h, line FROM l WHERE line <> ''),
    s AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM b),
    t AS (SELECT doc_id, section, h, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level, regexp_extract(line, '^#{{1,6}}\\s+(.+)', 1) AS title, regexp_replace(line, '^[-*]\\s+', '') AS text FROM s WHERE section > 0)
    SELECT doc_id, CAST(section AS BIGINT) AS section, max(title) FILTER (h) AS title, CAST(max(level) FILTER (h) AS INTEGER) AS level, CAST(sum(CASE WHEN h THEN 0 ELSE {WORDS} END) AS BIGINT) AS word_count FROM t GROUP BY doc_id, section""")
def sections(spark, sf_dir):
    return blocks.sections(blocks.markdown_blocks(docs(spark, sf_dir)))


@query(f"WITH {LINES}, s AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(line, '\\d+', '', 'g'), '\\s+', ' ', 'g'))) AS sig FROM l) SELECT doc_id, sig, count(*) AS n FROM s WHERE sig <> '' GROUP BY ALL")
def line_signatures(spark, sf_dir):
    return blocks.line_signatures(docs(spark, sf_dir))


@query(f"""WITH {LINES}, m AS (SELECT *, regexp_matches(line, '(?i)^\\s*\\d{{0,4}}\\s*\\|?\\s*p\\s*a\\s*g\\s*e\\b') AS label, regexp_matches(line, '^\\s*\\d{{1,4}}\\s*$') AS num,
    coalesce(lag(line) OVER w, '') = '' OR coalesce(lead(line) OVER w, '') = '' AS alone FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    k AS (SELECT *, bool_or(label) OVER (PARTITION BY doc_id) AS labelled FROM m)
    SELECT doc_id, pos, CASE WHEN label THEN 'label' ELSE 'number' END AS kind FROM k WHERE label OR (NOT labelled AND num AND alone)""")
def page_markers(spark, sf_dir):
    return blocks.page_markers(docs(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id, count(*) FILTER (regexp_matches(line, '^\\s*\\d+\\.\\d+(\\.\\d+)*\\s+\\S') AND length(line) < 150) >= 2 AS skeleton FROM l GROUP BY doc_id")
def decimal_skeleton(spark, sf_dir):
    return blocks.decimal_skeleton(docs(spark, sf_dir))


@query(f"""WITH {LINES}, t AS (SELECT *, {HEADER_LINE} AS header, {ROW_LINE} AS "row" FROM l),
    i AS (SELECT *, sum(CAST(NOT "row" AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM t), runs AS (SELECT doc_id, min(pos) AS pos, count(*) AS "rows" FROM i WHERE "row" GROUP BY doc_id, island),
    b AS (SELECT doc_id, pos, lag(pos) OVER o AS start, lag(header) OVER o AS header FROM t WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, start, "rows" FROM runs JOIN b USING (doc_id, pos) WHERE header""")
def table_regions(spark, sf_dir):
    return blocks.table_regions(docs(spark, sf_dir))


@query(f"WITH {ALL_LINES}, {_kinds('every', False)} SELECT doc_id, pos, line, kind FROM kinds")
def line_kinds(spark, sf_dir):
    return blocks.classify(docs(spark, sf_dir))


@query(f"WITH {ALL_LINES}, {_kinds('every', False)} SELECT doc_id, CAST(block AS BIGINT) AS block, type, x AS text FROM named")
def line_merge(spark, sf_dir):
    return blocks.merge_lines(docs(spark, sf_dir))


@query(f"WITH {ALL_LINES}, {_kinds('every', False)} SELECT doc_id, round(avg(CAST(type = 'list' AS INTEGER)), 3) AS list_ratio FROM named GROUP BY doc_id")
def list_ratio(spark, sf_dir):
    return blocks.list_ratio(blocks.merge_lines(docs(spark, sf_dir)))


@query(f"WITH {LINES} SELECT doc_id, pos, regexp_replace(regexp_extract(line, '^#{{1,6}}\\s+(.+)', 1), '^\\s*\\d+(\\.\\d+)*\\.?\\s*', '') AS title FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s+.')")
def heading_titles(spark, sf_dir):
    return blocks.heading_titles(blocks.markdown_blocks(docs(spark, sf_dir)))


@query(f"WITH {MARKED} SELECT doc_id, pos, line, marker FROM marked WHERE dropped")
def furniture_lines(spark, sf_dir):
    return normalise.marked_lines(docs(spark, sf_dir)).where("dropped").select("doc_id", "pos", "line", "marker")


@query(f"WITH {MARKED}, {_kinds('marked', True)}, {PARTS} SELECT * FROM parts")
def normalised_blocks(spark, sf_dir):
    return normalise.clean_blocks(docs(spark, sf_dir))


@query(f"""WITH {MARKED}, {_kinds('marked', True)}, {PARTS},
    t AS (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY pos, part) FILTER (type <> 'note'), '') AS text, round(avg(CAST(type = 'list' AS INTEGER)), 3) AS list_ratio, count(*) AS blocks FROM parts GROUP BY doc_id)
    SELECT doc_id, t.text, list_ratio, blocks FROM t""")
def normalised_documents(spark, sf_dir):
    return normalise.normalise(docs(spark, sf_dir)).where("size(blocks) > 0").select("doc_id", "text", "list_ratio", F.size("blocks").cast("bigint").alias("blocks"))


@query(f"WITH {LINES} SELECT doc_id, pos, {_is_math("line")} AS dense FROM l WHERE line <> ''")
def math_dense(spark, sf_dir):
    return blocks.lines_of(docs(spark, sf_dir)).where("line <> ''").select("doc_id", "pos", blocks.is_math_dense(F.col("line")).alias("dense"))


@query(f"""WITH {LINES}, h AS (SELECT doc_id, regexp_extract(line, '^#{{1,6}}\\s+(.+)', 1) AS t, pos FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s+.')),
    f AS (SELECT doc_id, arg_min(t, pos) AS t FROM h WHERE strlen(t) > 3 GROUP BY doc_id) SELECT d.doc_id, left(coalesce(f.t, 'document-' || d.doc_id), 255) AS title FROM d LEFT JOIN f USING (doc_id)""")
def titles(spark, sf_dir):
    d = docs(spark, sf_dir)
    return blocks.titles(d, blocks.markdown_blocks(d), F.concat(F.lit("document-"), F.col("doc_id")))


# -- references, statistics, phrases ----------------------------------------------------------------------------------

FOUND = f"""{DOCS}, r AS (
    SELECT doc_id, 1 AS kind, unnest(range(len(x))) AS ord, unnest(x) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '10\\.\\d{{4,}}/[^\\s\\]]+') AS x FROM d)
    UNION ALL SELECT doc_id, 2, unnest(range(len(x))), unnest(x) FROM (SELECT doc_id, regexp_extract_all(text, '(?i)https?://[^\\s)\\]"''<>]+') AS x FROM d)
    UNION ALL SELECT doc_id, 3, unnest(range(len(x))), unnest(x) FROM (SELECT doc_id, regexp_extract_all(text, '\\[[\\d,\\s\\-]+\\]') AS x FROM d)),
    k AS (SELECT doc_id, kind, CAST(ord AS INTEGER) AS ord, raw, CASE WHEN kind = 1 THEN raw END AS doi,
      CASE kind WHEN 1 THEN 'https://doi.org/' || raw WHEN 2 THEN regexp_replace(raw, '[.,;]+$', '') END AS url,
      lower(CASE WHEN kind = 2 THEN regexp_replace(raw, '[.,;]+$', '') ELSE raw END) AS key FROM r)"""


@query(f"WITH {FOUND} SELECT * FROM k")
def references_extract(spark, sf_dir):
    return references.extract(docs(spark, sf_dir))


@query(f"""WITH {FOUND}, f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY kind, ord) = 1)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, ord) AS INTEGER) AS n, raw, doi, url FROM f QUALIFY n <= 100""")
def references_dedupe(spark, sf_dir):
    return references.dedupe(references.extract(docs(spark, sf_dir)))


@query(f"""WITH {DOCS}, c AS (SELECT doc_id, {WORDS} AS w, strlen(text) AS bytes, regexp_replace(text, '\\r\\n|\\n|\\r', '. ', 'g') AS flat, greatest(1, len(regexp_extract_all(lower(text), '[aeiouy]+'))) AS y FROM d),
    s AS (SELECT *, greatest(1, len(regexp_extract_all(CASE WHEN regexp_matches(trim(flat, {BLANKS}), '[.!?]$') THEN flat ELSE flat || '.' END, '[.!?]+'))) AS s FROM c)
    SELECT doc_id, w AS word_count, CAST(bytes AS BIGINT) AS character_count, CAST(s AS BIGINT) AS sentence_count, CAST(greatest(1, ceil(w / 200.0)) AS BIGINT) AS reading_time_minutes,
    round(CASE WHEN w = 0 THEN 0.0 ELSE 206.835 - 1.015 * (w / s) - 84.6 * (y / w) END, 1) AS flesch_reading_ease FROM s""")
def document_stats(spark, sf_dir):
    return stats.document_stats(docs(spark, sf_dir))


LANGUAGE = ", ".join(f"{{'n': len(list_filter(t, lambda x: x IN ({', '.join(chr(39) + w + chr(39) for w in known.split())}))), 'o': {-i}, 'lang': '{lang}'}}" for i, (lang, known) in enumerate(stats.LANGUAGES.items()))


@query(f"""WITH {DOCS}, t AS (SELECT doc_id, {WORDS} AS w, regexp_split_to_array(lower(left(text, 2000)), '[^\\p{{L}}]+') AS t FROM d), h AS (SELECT doc_id, w, list_max([{LANGUAGE}]) AS best FROM t)
    SELECT doc_id, CASE WHEN w < 25 THEN 'und' WHEN best.n = 0 THEN 'en' ELSE best.lang END AS language FROM h""")
def language(spark, sf_dir):
    return stats.language(docs(spark, sf_dir))


#: Key phrases: runs of words between stop words and punctuation, scored by degree over frequency.
RAKE = f"""{DOCS}, pc AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '{quality.GLYPHS}', ' ', 'g'), '\\r\\n|\\r|\\n', ' . ', 'g')), '[^\\p{{L}}\\p{{N}}\\s''-]+') AS ps FROM d)),
    tk AS (SELECT doc_id, i, unnest(range(len(ws))) AS j, unnest(ws) AS w FROM (SELECT doc_id, i, regexp_split_to_array(trim(p, {BLANKS}), '\\s+') AS ws FROM pc WHERE trim(p, {BLANKS}) <> '')),
    rn AS (SELECT *, w IN ({", ".join("'" + w + "'" for w in stats.STOP)}) AS stop, sum(CAST(w IN ({", ".join("'" + w + "'" for w in stats.STOP)}) AS INTEGER)) OVER (PARTITION BY doc_id, i ORDER BY j) AS run FROM tk),
    ph AS (SELECT doc_id, i, run, string_agg(w, ' ' ORDER BY j) AS phrase, list(w ORDER BY j) AS words FROM rn WHERE NOT stop GROUP BY doc_id, i, run HAVING regexp_matches(string_agg(w, ' ' ORDER BY j), '\\p{{L}}')),
    wt AS (SELECT doc_id, word, sum(n) / count(*) AS w FROM (SELECT doc_id, unnest(words) AS word, len(words) AS n FROM ph) GROUP BY doc_id, word),
    sc AS (SELECT doc_id, phrase, round(sum(wt.w), 4) AS score FROM (SELECT DISTINCT doc_id, phrase, unnest(words) AS word, unnest(range(len(words))) AS at FROM ph) JOIN wt USING (doc_id, word) GROUP BY doc_id, phrase),
    rk AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INTEGER) AS rank, phrase, score FROM sc WHERE length(phrase) BETWEEN 3 AND 80 QUALIFY rank <= 15)"""


@query(f"WITH {RAKE} SELECT * FROM rk")
def rake_keyphrases(spark, sf_dir):
    return stats.rake(docs(spark, sf_dir))


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z''-]+')) AS phrase FROM d),
    n AS (SELECT doc_id, phrase, CAST(count(*) AS DOUBLE) AS score FROM w WHERE length(phrase) >= 4 AND phrase NOT IN ({", ".join(f"'{w}'" for w in stats.FALLBACK_STOP)}) GROUP BY ALL)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INTEGER) AS rank, phrase, score FROM n QUALIFY rank <= 15""")
def keyphrase_fallback(spark, sf_dir):
    return stats.frequent_words(docs(spark, sf_dir))


# -- summaries --------------------------------------------------------------------------------------------------------

SENTENCES = f"""{DOCS}, p AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, {BLANKS}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x NOT IN ('', '0')) AS ss FROM d),
    s AS (SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM p),
    g AS (SELECT *, regexp_replace(CASE WHEN regexp_extract(sentence, '^(.{{2,60}}?):\\s', 1) <> '' THEN regexp_extract(sentence, '^(.{{2,60}}?):\\s', 1) ELSE sentence END, '\\s+', ' ', 'g') AS sig0 FROM s)"""


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM s")
def sentences(spark, sf_dir):
    return summary.sentences(docs(spark, sf_dir))


@query(f"WITH {SENTENCES} SELECT doc_id, lower(sig0) AS signature, count(*) AS n FROM g GROUP BY ALL HAVING n >= 2")
def template_signatures(spark, sf_dir):
    return summary.templates(summary.sentences(docs(spark, sf_dir)))


@query(f"""WITH {SENTENCES}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(sig0)) AS n FROM g),
    u AS (SELECT *, sum(CAST(n < 2 AS INTEGER)) OVER (PARTITION BY doc_id) AS single FROM t),
    v AS (SELECT doc_id, pos, sentence, sum(strlen(sentence)) OVER (PARTITION BY doc_id ORDER BY pos) AS bytes FROM u WHERE n < 2 OR single < 3)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM v WHERE bytes <= 40000""")
def scaffold_removed(spark, sf_dir):
    return summary.head(summary.without_scaffold(summary.sentences(docs(spark, sf_dir))))


@query(f"""WITH {SENTENCES}, c AS (SELECT doc_id, pos, sentence, 4 * len(regexp_extract_all(sentence, '[€£$]')) + 3 * len(regexp_extract_all(sentence, '%')) + 2 * len(regexp_extract_all(sentence, '\\b\\d{{2,}}\\b'))
      + len(regexp_extract_all(sentence, '{stats.CHANGE}')) AS score FROM s WHERE regexp_matches(sentence, '{summary.SIGNAL}') AND len(regexp_extract_all(sentence, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}')) < 2),
    o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(sentence, '\\s+', ' ', 'g')) ORDER BY pos) = 1)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS INTEGER) AS rank, sentence, CAST(score AS INTEGER) AS score FROM o QUALIFY rank <= 5""")
def key_findings(spark, sf_dir):
    return summary.findings(summary.sentences(docs(spark, sf_dir)))


#: Sentences without templates, their words, and pairs of sentences that share some.
PAIRS = f"""{SENTENCES}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(sig0)) AS n FROM g),
    u AS MATERIALIZED (SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM (SELECT *, sum(CAST(n < 2 AS INTEGER)) OVER (PARTITION BY doc_id) AS single FROM t) WHERE n < 2 OR single < 3),
    w AS (SELECT doc_id, pos, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({", ".join("'" + w + "'" for w in stats.STOP)}))) AS ws FROM u),
    e AS MATERIALIZED (SELECT doc_id, pos, greatest(len(ws), 2) AS n, unnest(ws) AS term FROM w),
    pr AS MATERIALIZED (SELECT a.doc_id, a.pos AS i, b.pos AS j, count(*) / (ln(any_value(a.n)) + ln(any_value(b.n))) AS weight FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos GROUP BY a.doc_id, a.pos, b.pos)"""
_ROUNDS = ",\n".join(
    f"s{k} AS MATERIALIZED (SELECT u.doc_id, u.pos, {1 - summary.DAMPING:.2f} + {summary.DAMPING} * coalesce(x.s, 0) AS score FROM u LEFT JOIN (SELECT q.doc_id, q.i, sum(q.w * s.score) AS s FROM q JOIN s{k - 1} s ON s.doc_id = q.doc_id AND s.pos = q.j GROUP BY q.doc_id, q.i) x ON x.doc_id = u.doc_id AND x.i = u.pos)"
    for k in range(1, summary.ROUNDS + 1)
)
RANKED = f"""{PAIRS}, dirs AS MATERIALIZED (SELECT doc_id, i, j, weight FROM pr UNION ALL SELECT doc_id, j, i, weight FROM pr),
    q AS MATERIALIZED (SELECT doc_id, i, j, weight / sum(weight) OVER (PARTITION BY doc_id, j) AS w FROM dirs), s0 AS MATERIALIZED (SELECT doc_id, pos, 1.0 AS score FROM u), {_ROUNDS},
    ranked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, pos) AS INTEGER) AS rank, pos, sentence FROM s{summary.ROUNDS} JOIN u USING (doc_id, pos) QUALIFY rank <= {summary.KEPT})"""


@query(f"WITH {RANKED} SELECT * FROM ranked")
def textrank(spark, sf_dir):
    return summary.in_rows(summary.ranked_sentences(summary.plain_sentences(docs(spark, sf_dir))))


@query(f"WITH {PAIRS} SELECT doc_id, i, j, round(weight, 6) AS weight FROM pr")
def textrank_pairs(spark, sf_dir):
    weights = summary.pair_weights(summary.plain_sentences(docs(spark, sf_dir)))
    return weights.withColumn("weight", F.round("weight", 6))


def _first_words(x: str, n: int) -> str:
    words = f"regexp_split_to_array(trim({x}, {BLANKS}), '\\s+')"
    return f"CASE WHEN len({words}) > {n} THEN array_to_string(list_slice({words}, 1, {n}), ' ') || '…' ELSE {x} END"


@query(f"""WITH {RANKED}, j AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY rank) FILTER (rank <= 5) AS a, string_agg(sentence, ' ' ORDER BY rank) AS b FROM ranked GROUP BY doc_id)
    SELECT doc_id, {_first_words("a", 150)} AS short, {_first_words("b", 500)} AS extended FROM j""")
def summaries(spark, sf_dir):
    return summary.summaries_of(summary.ranked_sentences(summary.plain_sentences(docs(spark, sf_dir))))


@query(f"""WITH {LINES}, h AS (SELECT doc_id, pos, regexp_replace(regexp_extract(line, '^#{{1,6}}\\s+(.+)', 1), '^\\s*\\d+(\\.\\d+)*\\.?\\s*', '') AS title FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s+.')),
    g AS (SELECT doc_id, count(*) AS n, string_agg(title, '; ' ORDER BY pos) AS titles FROM h GROUP BY doc_id HAVING count(*) >= 2)
    SELECT doc_id, 'Defines ' || coalesce([{", ".join(f"'{w}'" for w in summary.NUMBERS)}][n + 1], CAST(n AS VARCHAR)) || ' sections: ' || titles || '.' AS body FROM g""")
def templated_summary(spark, sf_dir):
    return summary.templated(blocks.heading_titles(blocks.markdown_blocks(docs(spark, sf_dir))))


# -- quality ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {DOCS}, f AS (SELECT doc_id, replace(unnest(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])(\\p{{Ll}}{{3,}}  (?:{quality.ENDINGS}))(?:$|[^\\p{{L}}\\p{{N}}_])', 1)), '  ', ' ') AS fragment FROM d)
    SELECT DISTINCT doc_id, fragment FROM f WHERE split_part(fragment, ' ', 1) NOT IN ({", ".join(f"'{w}'" for w in quality.STEMS)})""")
def split_artefacts(spark, sf_dir):
    return quality.split_artefacts(docs(spark, sf_dir))


@query(f"WITH {DOCS} SELECT doc_id, CAST(len(regexp_extract_all(text, '{quality.MOJIBAKE}')) AS BIGINT) AS pairs FROM d WHERE pairs > 0")
def mojibake_pairs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(quality.MOJIBAKE)).cast("bigint").alias("pairs")).where("pairs > 0")


REPORT = ("doc_id", "title", "doc_class", "word_count", "language", "n_sections", "n_references", "n_phrases", "list_ratio", "summary", "findings_note", "structure_score", "content_score", "reference_score", "knowledge_score", "stars", "verdict", "verdict_flags")


@query()
def document_reports(spark, sf_dir):
    return documents.document_reports(docs(spark, sf_dir)).select(*REPORT, F.size("issues").alias("issues"), F.size("notes").alias("notes"))


# -- citations --------------------------------------------------------------------------------------------------------

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in cite.STOP)
TOKENS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s-]+', ' ', 'g'), '\\s+'), lambda t: trim(t, '-')), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^\\d+$') AND t NOT IN ({STOPS}))"
BM25 = f"""q AS (SELECT item_id AS passage_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
    tf AS (SELECT doc_id AS ref_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL),
    ln AS (SELECT ref_id, sum(tf) AS len FROM tf GROUP BY ref_id), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM ln) AS total),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    parts AS (SELECT passage_id, ref_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(1.0, total / n))) * least(qtf, 5) AS contribution
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN ln USING (ref_id), st),
    scores AS (SELECT passage_id, ref_id, sum(contribution) AS score FROM parts GROUP BY ALL),
    aff AS (SELECT passage_id, ref_id, score, round(score / max(score) OVER (), 2) AS affinity FROM scores),
    matched AS (SELECT passage_id, ref_id, affinity, CAST(row_number() OVER (PARTITION BY passage_id ORDER BY affinity DESC, round(score, 9) DESC, ref_id) AS INTEGER) AS rank FROM aff WHERE affinity >= 0.15 QUALIFY rank <= 3)"""


def passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), "text")


def bm25(spark, sf_dir):
    return cite.bm25(passages(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), "text"))


@query(f"WITH {BM25} SELECT passage_id, ref_id, round(score, 6) AS score FROM scores")
def bm25_scores(spark, sf_dir):
    return cite.scores(bm25(spark, sf_dir)).select("passage_id", "ref_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT * FROM matched")
def bm25_matches(spark, sf_dir):
    return cite.matches(cite.affinities(cite.scores(bm25(spark, sf_dir))))


@query(f"""WITH {BM25}, e AS (SELECT p.passage_id, p.ref_id, term, row_number() OVER (PARTITION BY p.passage_id, p.ref_id ORDER BY round(contribution, 9) DESC, term) AS k FROM parts p JOIN matched m USING (passage_id, ref_id) QUALIFY k <= 6)
    SELECT passage_id, ref_id, string_agg(term, ' ' ORDER BY k) AS shared FROM e GROUP BY ALL""")
def bm25_evidence(spark, sf_dir):
    parts = bm25(spark, sf_dir)
    return cite.evidence(parts, cite.near(cite.matches(cite.affinities(cite.scores(parts))), passages(spark, sf_dir)))


@query(f"""WITH {BM25}, k AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY affinity DESC, passage_id) AS k FROM matched)
    SELECT ref_id, CAST(round(100 * avg(affinity) FILTER (k <= 5)) AS INTEGER) AS suitability, count(*) AS coverage FROM k GROUP BY ref_id""")
def reference_suitability(spark, sf_dir):
    return cite.suitability(cite.matches(cite.affinities(cite.scores(bm25(spark, sf_dir)))))


@query(f"WITH {BM25} SELECT ref_id, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY affinity DESC, passage_id) AS INTEGER) AS k, passage_id, affinity FROM matched QUALIFY k <= 5")
def reference_passages(spark, sf_dir):
    return cite.top_passages(cite.matches(cite.affinities(cite.scores(bm25(spark, sf_dir)))))


@query("""WITH p AS (SELECT source, left(d, 2) AS part, sha256(string_agg(d, '|' ORDER BY d)) AS d FROM (SELECT source, sha256(text) AS d FROM documents) GROUP BY ALL)
    SELECT source, sha256(string_agg(d, '|' ORDER BY part)) AS fingerprint FROM p GROUP BY source""")
def set_fingerprint(spark, sf_dir):
    return cite.set_fingerprint(table(spark, sf_dir, "documents"), "source", F.col("text"))


@query("SELECT conv_id, sha256(string_agg(d, '|' ORDER BY d)) AS fingerprint FROM (SELECT conv_id, sha256(coalesce(text, '')) AS d FROM conversations) GROUP BY conv_id")
def exact_fingerprint(spark, sf_dir):
    """Each conversation's turns as a set."""
    return cite.exact_fingerprint(table(spark, sf_dir, "conversations"), "conv_id", F.col("text"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 120) AS BIGINT))) AS passage FROM w)
    SELECT doc_id, CAST(passage AS INTEGER) AS passage, array_to_string(list_slice(w, passage * 120 + 1, passage * 120 + 120), ' ') AS text FROM p""")
def passage_windows(spark, sf_dir):
    return cite.windows(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH {MARKED}, {_kinds('marked', True)}, {PARTS}, p AS (SELECT doc_id, text, instr(text, '#') > 0 AND strlen(substr(text, 1, instr(text, '#') - 1)) < 8192 AS md FROM d),
    blk AS (SELECT x.doc_id, x.pos, x.part, x.type, x.text FROM parts x JOIN p USING (doc_id) WHERE NOT md
      UNION ALL SELECT l.doc_id, pos, 1, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.') THEN 'heading' ELSE 'paragraph' END,
        CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.') THEN regexp_extract(line, '^#{{1,6}}\\s+(.+)', 1) WHEN regexp_matches(line, '^[-*]\\s+') THEN regexp_replace(line, '^[-*]\\s+', '') ELSE line END FROM l JOIN p USING (doc_id) WHERE md AND line <> ''),
    sec AS (SELECT *, sum(CAST(type = 'heading' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos, part) AS s FROM blk),
    pas AS (SELECT doc_id, s, coalesce(max(text) FILTER (type = 'heading'), '') AS title, trim(coalesce(string_agg(text, ' ' ORDER BY pos, part) FILTER (type <> 'heading' AND text <> ''), '')) AS text FROM sec GROUP BY doc_id, s),
    good AS (SELECT doc_id, s, CASE WHEN s = 0 THEN 'Preamble' WHEN title = '' THEN 'Section' ELSE title END AS label, title, text, count(*) OVER (PARTITION BY doc_id) AS n FROM pas WHERE text <> ''),
    body AS (SELECT p.doc_id, any_value(CASE WHEN md THEN p.text ELSE t.text END) AS whole FROM p LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos, part) AS text FROM parts WHERE type <> 'note' GROUP BY doc_id) t USING (doc_id) GROUP BY p.doc_id),
    win AS (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 120) AS BIGINT))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(whole, '\\s+'), lambda x: x <> '') AS w FROM body WHERE doc_id NOT IN (SELECT doc_id FROM good WHERE n > 1))),
    every AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS passage, label, title, text FROM good WHERE n > 1
      UNION ALL SELECT doc_id, CAST(i AS INTEGER), 'Passage ' || (i + 1) || ' of ' || CAST(ceil(len(w) / 120) AS BIGINT), '', array_to_string(list_slice(w, i * 120 + 1, i * 120 + 120), ' ') FROM win)
    SELECT * FROM every WHERE passage < {cite.PASSAGES}""")
def document_passages(spark, sf_dir):
    return cite.passages(normalise.prepare(docs(spark, sf_dir)))


# -- table blocks -----------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, l_linenumber, [l_linenumber::VARCHAR, 'part ' || l_partkey, l_returnflag || '|' || l_linestatus] AS cells FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
    g AS (SELECT o_orderkey AS doc_id, any_value(o_orderpriority) AS priority, count(l_linenumber) AS n, string_agg('| ' || array_to_string(list_transform(cells, lambda c: replace(c, '|', chr(92) || '|')), ' | ') || ' |', chr(10) ORDER BY l_linenumber, cells) AS lines,
      string_agg(array_to_string(cells, chr(10)), chr(10) ORDER BY l_linenumber, cells) AS words FROM r GROUP BY o_orderkey)
    SELECT doc_id, CASE WHEN n > 0 THEN 'form' ELSE 'prose' END AS doc_class, 'Order ' || doc_id AS title, """ + _words("priority") + " + CASE WHEN n > 0 THEN " + _words("('line' || chr(10) || 'part' || chr(10) || 'flags' || chr(10) || words)") + """ ELSE 0 END AS word_count,
      CASE WHEN n > 0 THEN '| line | part | flags |' || chr(10) || '| --- | --- | --- |' || chr(10) || lines END AS table_markdown FROM g""")
def order_tables(spark, sf_dir):
    """Every order as a document of a heading, a paragraph and its lines as a table block: section words, class and Markdown."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("part "), "l_partkey"), F.concat_ws("|", "l_returnflag", "l_linestatus")).alias("cells"))
    rows = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "cells"))), lambda x: x["cells"]).alias("rows"))
    orders_ = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    one = lambda kind, text, level, rows: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), level.cast("int").alias("level"), rows.cast(normalise.ROWS).alias("rows"))
    none, header = F.lit(None), F.array(F.array(*map(F.lit, ("line", "part", "flags"))))
    given = F.array(one("heading", F.concat(F.lit("Order "), "o_orderkey"), F.lit(1), none), one("paragraph", F.col("o_orderpriority"), none, none), one("table", none, none, F.when(F.col("rows").isNotNull(), F.concat(header, "rows"))))
    made = orders_.select(F.col("o_orderkey").alias("doc_id"), normalise.given_blocks(given).alias("blocks"))
    tables = F.filter("blocks", lambda x: x["type"] == "table")
    first = F.get(documents.sections_of(F.col("blocks")), F.lit(0))
    return made.select("doc_id", documents.doc_class(F.lit(False), F.size(tables)).alias("doc_class"), first["title"].alias("title"), first["words"].alias("word_count"), F.get(F.transform(tables, writers.block_markdown), F.lit(0)).alias("table_markdown")).withColumn("table_markdown", F.regexp_replace("table_markdown", "\n$", ""))


# -- library ----------------------------------------------------------------------------------------------------------

REPORTS = "r AS (SELECT doc_id AS id, sha256(text) AS fingerprint, left(trim(string_split(text, chr(10))[1]), 255) AS title, upper(lang) AS source_type, CAST(strlen(text) AS BIGINT) AS size_bytes, left(text, 500) AS excerpt, make_timestamp((1700000000 + doc_id * 60) * 1000000) AS created_at FROM documents)"


def reports(spark, sf_dir):
    return library.as_reports(table(spark, sf_dir, "documents"))


@query(f"WITH {REPORTS}, w AS (SELECT id, regexp_split_to_array(strip_accents(lower(title || ' ' || excerpt)), '[^\\p{{L}}\\p{{N}}_]+') AS ws FROM r) SELECT id FROM w WHERE list_contains(ws, 'the') OR len(list_filter(ws, lambda x: starts_with(x, 'ent'))) > 0")
def library_search(spark, sf_dir):
    return library.search(reports(spark, sf_dir), "the ent").select("id")


@query(f"WITH {REPORTS}, w AS (SELECT id, unnest(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{{L}}\\p{{N}}_]+') || regexp_split_to_array(strip_accents(lower(excerpt)), '[^\\p{{L}}\\p{{N}}_]+')) AS x FROM r) SELECT id, count(*) AS hits FROM w WHERE x IN ('fur', 'ete') OR starts_with(x, 'ent') GROUP BY id")
def library_index(spark, sf_dir):
    """The library indexed, and searched in the index: two words with accents and a prefix."""
    path = Workspace(spark, "index").base
    index.write(reports(spark, sf_dir), path)
    return index.search(index.read(spark, path), "FÜR été ent").select(F.col("report_id").alias("id"), "hits")


@query(f"WITH {REPORTS} SELECT source_type, count(*) AS n FROM r WHERE source_type = 'EN' GROUP BY ALL")
def library_count(spark, sf_dir):
    return reports(spark, sf_dir).where("source_type = 'EN'").groupBy("source_type").agg(F.count("*").alias("n"))


@query(f"WITH {REPORTS} SELECT id, title FROM r ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20")
def library_page(spark, sf_dir):
    return library.page(reports(spark, sf_dir), 2).select("id", "title")


@query(f"WITH {REPORTS} SELECT id, fingerprint, size_bytes FROM r WHERE id = 7")
def report_lookup(spark, sf_dir):
    return reports(spark, sf_dir).where("id = 7").select("id", "fingerprint", "size_bytes")


@query(f"WITH {REPORTS}, g AS (SELECT fingerprint, min(id) AS earliest, max(id) AS latest FROM r GROUP BY ALL HAVING count(*) > 1) SELECT id, earliest, latest FROM r JOIN g USING (fingerprint)")
def duplicate_documents(spark, sf_dir):
    return library.duplicates(reports(spark, sf_dir))


@query(f"WITH {REPORTS} SELECT CAST(ord AS INTEGER) AS ord, id, title FROM r JOIN (VALUES (0, 9), (1, 3), (2, 12)) AS v(ord, id) USING (id)")
def merge_select(spark, sf_dir):
    return library.select_ids(reports(spark, sf_dir), [9, 3, 9, 12, -77]).select("ord", "id", "title")


@query(f"WITH {RAKE} SELECT min(phrase) AS phrase, round(sum(score), 4) AS score FROM rk GROUP BY strip_accents(lower(phrase)) ORDER BY score DESC, phrase LIMIT 30")
def merge_keyphrases(spark, sf_dir):
    return library.merge_keyphrases(stats.rake(docs(spark, sf_dir)))


@query(f"""WITH {FOUND}, f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY kind, ord) = 1), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, ord) AS INTEGER) AS n FROM f QUALIFY n <= 100),
    m AS (SELECT doc_id, n, raw, coalesce('doi:' || lower(doi), 'url:' || lower(url), 'raw:' || lower(trim(raw))) AS key FROM n) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, n) = 1""")
def merge_references(spark, sf_dir):
    return library.merge_references(references.dedupe(references.extract(docs(spark, sf_dir))), F.col("doc_id"))


@query(f"""WITH {DOCS}, ls AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)), h AS (SELECT *, regexp_matches(line, '^##\\s+') AS head FROM ls),
    n AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h), g AS (SELECT doc_id, section, max(regexp_replace(line, '^##\\s+', '')) FILTER (head) AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS body FROM n WHERE section > 0 GROUP BY doc_id, section)
    SELECT doc_id, CAST(section AS BIGINT) AS section, CASE WHEN regexp_matches(title, '^\\d+\\.\\s+') THEN section || '.' || regexp_replace(title, '^(\\d+)\\.\\s+', '\\1 ') ELSE title END AS title, body FROM g""")
def report_sections(spark, sf_dir):
    s = library.sections(docs(spark, sf_dir))
    return s.withColumn("title", library.renumber(F.col("title"), F.col("section")))


# -- profiles ---------------------------------------------------------------------------------------------------------

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")
TEXTS = ("o_orderstatus", "o_orderdate", "o_orderpriority")
LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
LINE_NUMBERS = LINE_COLUMNS[:8]


def orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return profile.as_text(df, "o_orderkey"), df.columns


def long_sql(columns, kind="VARCHAR", source="orders") -> str:
    """(column, value, _row) of the columns, all of one type."""
    return f'SELECT "column", value, _row FROM (SELECT o_orderkey AS _row, ' + ", ".join(f"CAST({c} AS {kind}) AS {c}_" for c in columns) + f" FROM {source}) UNPIVOT (value FOR \"column\" IN (" + ", ".join(f"{c}_ AS '{c}'" for c in columns) + "))"


LONG = f"x AS ({long_sql(ORDER_COLUMNS)})"
BARE = "replace(trim(value), ',', '')"
DAY = f"""(({_matches("value", *profile.DATES)}) AND coalesce(try_strptime(CASE WHEN regexp_matches(value, '{profile.DATES[0]}') THEN regexp_split_to_array(value, '[ T]')[1] ELSE value END, ['%Y-%m-%d', '%m/%d/%Y', '%d-%b-%Y']) IS NOT NULL, false))"""
FIRST = 'SELECT "column", value FROM x QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY _row, value) <= {n}'
TYPES = f"""ft AS ({FIRST.format(n=profile.TYPE_SAMPLE)}),
    sh AS (SELECT "column", avg(CAST(lower(trim(value)) IN ({", ".join(f"'{w}'" for w in profile.BOOLEANS)}) AS INTEGER)) AS b, avg(CAST(regexp_matches({BARE}, '^-?[0-9]+$') AS INTEGER)) AS i,
      avg(CAST(regexp_matches({BARE}, '{tx.NUMERIC}') AS INTEGER)) AS f, avg(CAST({DAY} AS INTEGER)) AS d FROM ft GROUP BY "column"),
    types AS (SELECT "column", CASE WHEN b >= 0.95 THEN 'boolean' WHEN i >= 0.95 THEN 'integer' WHEN f >= 0.95 THEN 'float' WHEN d >= 0.9 THEN 'date' ELSE 'string' END AS type,
      round(CASE WHEN b >= 0.95 THEN b WHEN i >= 0.95 THEN i WHEN f >= 0.95 THEN f WHEN d >= 0.9 THEN d ELSE 1.0 END, 3) AS type_agreement FROM sh)"""


@query(f"""WITH {LONG} SELECT "column", count(*) AS total, count(*) AS "count", CAST(0 AS BIGINT) AS nulls, 0.0 AS null_rate, count(DISTINCT lower(value)) AS "distinct", round(count(DISTINCT lower(value)) / count(*), 4) AS cardinality_ratio, count(DISTINCT lower(value)) = 1 AS constant FROM x GROUP BY "column" """)
def profile_counts(spark, sf_dir):
    return profile.counts(*orders(spark, sf_dir))


@query(f"WITH {LONG}, {TYPES} SELECT * FROM types")
def profile_types(spark, sf_dir):
    return profile.types(*orders(spark, sf_dir))


@query(f"""WITH x AS ({long_sql(NUMBERS, "DOUBLE")})
    SELECT "column", count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM x GROUP BY "column" """)
def profile_numeric(spark, sf_dir):
    text, _ = orders(spark, sf_dir)
    stats = profile.numeric_stats(text, list(NUMBERS))
    return stats.withColumns({c: F.round(c, 2) for c in ("mean", "std")} | {c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(f"""WITH x AS ({long_sql(NUMBERS, "DOUBLE")}),
    q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM x GROUP BY ALL) SELECT "column", count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM x JOIN q USING ("column") GROUP BY ALL""")
def profile_outliers(spark, sf_dir):
    text, _ = orders(spark, sf_dir)
    return profile.outliers(text, list(NUMBERS), profile.numeric_stats(text, list(NUMBERS)))


@query(f'WITH x AS ({long_sql(TEXTS)}) SELECT "column", CAST(min(length(value)) AS INTEGER) AS min_len, CAST(max(length(value)) AS INTEGER) AS max_len, round(avg(length(value)), 1) AS avg_len FROM x GROUP BY "column"')
def profile_lengths(spark, sf_dir):
    return profile.lengths(orders(spark, sf_dir)[0], list(TEXTS))


@query(f'WITH x AS ({long_sql(TEXTS)}), n AS (SELECT "column", lower(value) AS value, count(*) AS n FROM x GROUP BY ALL) SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank, value, n FROM n QUALIFY rank <= 3')
def profile_top_values(spark, sf_dir):
    return profile.top_values(orders(spark, sf_dir)[0], list(TEXTS))


@query(f"""WITH {LONG}, fp AS ({FIRST.format(n=profile.PII_SAMPLE)}),
    sh AS (SELECT "column", avg(CAST(regexp_matches(trim(value), '{profile.EMAIL}') AS INTEGER)) AS m, avg(CAST(regexp_matches(trim(value), '{profile.POSTCODE}') AS INTEGER)) AS e,
      avg(CAST(regexp_matches(trim(value), '{profile.PHONE}') AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 AS INTEGER)) AS p FROM fp GROUP BY "column"),
    r AS (SELECT "column", CASE WHEN m >= 0.5 THEN 'email addresses' WHEN e >= 0.5 THEN 'Eircodes' WHEN p >= 0.5 THEN 'phone numbers' WHEN regexp_matches("column", '{profile.NAME_HINT}') THEN 'column name' END AS reason FROM sh)
    SELECT "column", reason IS NOT NULL AS pii, coalesce(reason, '') AS pii_reason FROM r""")
def profile_pii(spark, sf_dir):
    return profile.personal(*orders(spark, sf_dir))


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _pairs(LINE_NUMBERS)))
def profile_correlation(spark, sf_dir):
    text = profile.as_text(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return profile.correlations(text, list(LINE_NUMBERS)).withColumn("r", F.round("r", 6))


#: Beside the numbers, twice the quantity (a strong pair) and the price left after the discount.
MADE = {"l_double": "2 * l_quantity", "l_net": "l_extendedprice * (1 - l_discount)"}


@query("WITH m AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in MADE.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) AS r FROM m HAVING abs(corr({a}, {b})) >= 0.5" for a, b in _pairs((*LINE_NUMBERS, *MADE))))
def profile_strong_pairs(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").withColumns({k: F.expr(v) for k, v in MADE.items()})
    return profile.strong_pairs(profile.correlations(profile.as_text(made, "l_orderkey"), [*LINE_NUMBERS, *MADE]))


SQUARE = (*LINE_NUMBERS, *MADE)


@query("WITH m AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in MADE.items()) + " FROM lineitem) " + " UNION ALL ".join(f"""SELECT '{a}' AS "column", """ + ", ".join("1.0::DOUBLE AS " + b if a == b else f"round(corr({min(a, b, key=SQUARE.index)}, {max(a, b, key=SQUARE.index)}), 2) + 0.0 AS {b}" for b in SQUARE) + " FROM m" for a in SQUARE))
def profile_matrix(spark, sf_dir):
    """The square of correlations of lineitem's numbers."""
    made = table(spark, sf_dir, "lineitem").withColumns({k: F.expr(v) for k, v in MADE.items()})
    return profile.matrix(profile.correlations(profile.as_text(made, "l_orderkey"), list(SQUARE)), list(SQUARE))


@query('WITH x AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 3), g AS (SELECT *, count(*) AS n FROM x GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS "rows", count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM g')
def profile_duplicates(spark, sf_dir):
    """Whole rows of lineitem, third lines planted twice: the table itself repeats none."""
    df = table(spark, sf_dir, "lineitem")
    return profile.duplicates(profile.as_text(df.union(df.where("l_linenumber = 3")), "l_orderkey"), df.columns)


@query(f"""WITH {LONG}, {TYPES}, c AS (SELECT 1.0 AS completeness, coalesce(avg(type_agreement) FILTER (type NOT IN ('string', 'empty')), 1.0) AS consistency FROM types),
    i AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) / (SELECT count(*) FROM orders) AS integrity)
    SELECT completeness, round(consistency, 6) AS consistency, round(integrity, 6) AS integrity, CAST(round(100 * (0.5 * completeness + 0.4 * consistency + 0.1 * integrity)) AS INTEGER) AS score FROM c, i""")
def profile_score(spark, sf_dir):
    text, cols = orders(spark, sf_dir)
    return profile.score(profile.counts(text, cols), profile.types(text, cols), profile.duplicates(text, cols))


@query()
def profile_events(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "events"), "event_id")


@query()
def profile_findings(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    text, cols = profile.as_text(df, "c_custkey"), df.columns
    return profile.findings(profile.profile(df, "c_custkey"), profile.correlations(text, ["c_custkey", "c_nationkey", "c_acctbal"]), profile.duplicates(text, cols))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_reports(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*REPORT)


from . import redaction  # noqa: E402, F401  its queries are registered with the others
