"""The queries in DuckDB's SQL, for those that SQL can say. Each is written for small tables, apart from the operators' methods."""

from __future__ import annotations

from . import pii, quality

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
N = len(quality.RULES)


def _estimation() -> str:
    """Rounds of expectation-maximisation over the table `patterns` (votes, n), each a table; the last model is `m`."""
    weight = "list_sum(list_transform(range(1, {n}), lambda i: CASE votes[i] WHEN 1 THEN ln(g[i] / (1 - b[i])) WHEN -1 THEN ln((1 - g[i]) / b[i]) ELSE 0.0 END))".format(n=N + 1)
    start = quality.START
    out = [f"m0 AS MATERIALIZED (SELECT {start.share}::DOUBLE AS share, list_transform(range({N}), lambda i: {start.on_good[0]}::DOUBLE) AS g, list_transform(range({N}), lambda i: {start.on_bad[0]}::DOUBLE) AS b)"]
    for k in range(1, quality.ROUNDS + 1):
        out.append(f"e{k} AS MATERIALIZED (SELECT votes, n * p AS good, n * (1 - p) AS bad FROM (SELECT votes, n, 1 / (1 + exp(-(ln(share / (1 - share)) + {weight}))) AS p FROM patterns, m{k - 1}))")
        out.append(f"""r{k} AS MATERIALIZED (SELECT i, least(0.995, greatest(0.6, (coalesce(sum(good) FILTER (v = 1), 0) + {quality.PRIOR * start.on_good[0]}) / (coalesce(sum(good) FILTER (v <> 0), 0) + {quality.PRIOR})))::DOUBLE AS g,
             (coalesce(sum(bad) FILTER (v = -1), 0) + {quality.PRIOR * start.on_bad[0]}) / (coalesce(sum(bad) FILTER (v <> 0), 0) + {quality.PRIOR}) AS b
             FROM (SELECT i, votes[i] AS v, good, bad FROM e{k}, range(1, {N + 1}) AS t(i)) GROUP BY i)""")
        out.append(f"""m{k} AS MATERIALIZED (SELECT (SELECT least(0.98, greatest(0.02, (sum(good) + {quality.PRIOR * start.share}) / (sum(good) + sum(bad) + {quality.PRIOR})))::DOUBLE FROM e{k}) AS share,
             list(g ORDER BY i) AS g, list(least(0.98, greatest(0.02, greatest(1.5 * (1 - g), b)))::DOUBLE ORDER BY i) AS b FROM r{k})""")
    out.append(f"m AS MATERIALIZED (SELECT * FROM m{quality.ROUNDS}), scored AS (SELECT v.*, 1 / (1 + exp(-(ln(share / (1 - share)) + {weight}))) AS q FROM voted v, m)")
    return ",\n".join(out)


def _quality() -> str:
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in quality.RULES)
    known = ", ".join(f"'{w}'" for w in quality.FUNCTION_WORDS)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             w AS MATERIALIZED (SELECT doc_id, text, {WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
             windows AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 7), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM w WHERE len(w) >= 8)),
             twice AS (SELECT doc_id, s FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
             covered AS (SELECT doc_id, sum(new) AS n FROM (SELECT doc_id, least(8, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s), 8)) AS new FROM twice) GROUP BY doc_id),
             measured AS MATERIALIZED (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                 len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({known}))) AS n_function_words,
                 len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words, len(regexp_extract_all(text, '[.!?]')) AS n_ends FROM w LEFT JOIN covered USING (doc_id)),
             voted AS MATERIALIZED (SELECT *, [{votes}] AS votes, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
             patterns AS MATERIALIZED (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY votes ORDER BY votes),
             {_estimation()}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS quality FROM scored"""


#: Control strings, longest effects last: a backslash is doubled first, then put after the first character of each.
_ESCAPE = "text"
for _old, _new in (("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("<SYS>>", "<\\SYS>>"), ("</SYS>>", "<\\/SYS>>"), ("<<\\SYS>>", "<\\<\\SYS>>"), ("<<\\/SYS>>", "<\\<\\/SYS>>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]")):
    _ESCAPE = f"replace({_ESCAPE}, '{_old}', '{_new}')"

#: The kinds' patterns without look-around: maximal runs, checked afterwards, or word boundaries.
_FOUND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"[0-9-]{11,}",
    "key": r"\b(?:A[KS]IA[0-9A-Z]{16}\b|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "secret": r"[A-Za-z0-9_+/=-]{20,}",
    "passport": r"\b[A-Z]{1,2}[0-9]{6,8}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_BARE = "replace(m, ' ', '')"
_VALID = f"""CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(x, 3) AS INTEGER) <= 255)) = 4
    WHEN 'card' THEN length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INTEGER) WHEN x >= '5' THEN 2 * CAST(x AS INTEGER) - 9 ELSE 2 * CAST(x AS INTEGER) END)) % 10 = 0
    WHEN 'phone' THEN length({_DIGITS}) BETWEEN 10 AND 15
    WHEN 'iban' THEN length({_BARE}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr({_BARE}, 5) || left({_BARE}, 4), ''), lambda x: CASE WHEN x >= 'A' THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END), ''), ''), lambda x: CAST(x AS INTEGER)), lambda a, x: (a * 10 + x) % 97) = 1
    WHEN 'ssn' THEN regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')
    WHEN 'secret' THEN length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    ELSE true END"""


def _personal() -> str:
    kinds = (*pii.BASE, *pii.ADDED)
    found = " UNION ALL ".join(f"SELECT doc_id, '{k.name}' AS kind, {r} AS rank, regexp_extract_all(text, '{_FOUND[k.name]}') AS ms, regexp_split_to_array(text, '{_FOUND[k.name]}') AS gs FROM d" for r, k in enumerate(kinds))
    score = " ".join(f"WHEN '{k.name}' THEN round(least(1.0, {k.score}::DOUBLE + CASE WHEN regexp_matches(around, '(?i)(?:^|[^A-Za-z])(?:{k.context})') THEN 0.25 ELSE 0.0 END), 4)" for k in kinds)
    base = ", ".join(f"'{k.name}'" for k in pii.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.BASE)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
             u AS (SELECT doc_id, kind, rank, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g FROM f),
             p AS (SELECT doc_id, kind, rank, m, CAST(sum(length(m) + length(g)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM u),
             c AS MATERIALIZED (SELECT *, stop - length(m) AS start FROM p WHERE {_VALID}),
             v AS (SELECT c.*, substr(text, greatest(start - {pii.NEAR} + 1, 1), least(start, {pii.NEAR})) || chr(10) || substr(text, stop + 1, {pii.NEAR}) AS around FROM c JOIN d USING (doc_id)),
             s AS (SELECT *, kind || ':' || start || ':' || stop AS label, CASE kind {score} END AS score FROM v),
             k AS (SELECT * FROM s WHERE kind IN ({base}) OR score >= 0.5),
             g AS (SELECT doc_id, {counts}, sha256(coalesce(string_agg(label, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256, string_agg(label, ',' ORDER BY start, rank) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, rank) AS scores, count(*) AS n_spans FROM k GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN g USING (doc_id)"""


#: What an `article` element holds, as blocks; the pages have one each, and only these references in it.
_BLOCKS = r"regexp_split_to_array(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>')"
_PLAIN = "regexp_replace(x, '<[^>]*>', ' ', 'g')"
for _name, _char in (("quot;?", '"'), ("#x27;", "''"), ("#39;", "''"), ("lt;?", "<"), ("gt;?", ">"), ("amp;?", "&")):
    _PLAIN = f"regexp_replace({_PLAIN}, '&{_name}', '{_char}', 'g')"


SQL = {
    "op6_pii": _personal(),
    "op1_quality_rules": _quality(),
    "op2_chat_format": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, role)),
             o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
             s AS (SELECT conv_id, i, role, text, CASE WHEN before IS NULL THEN '<|im_start|>' || {_ESCAPE.replace("text", "role")} || '<|im_sep|>' WHEN before = role THEN '<|im_next|>'
                   ELSE '<|im_end|><|im_start|>' || {_ESCAPE.replace("text", "role")} || '<|im_sep|>' END || {_ESCAPE} AS piece FROM o),
             c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS whole, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, string_agg(piece, '' ORDER BY i) || '<|im_end|>' AS formatted FROM s GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(formatted) AS formatted_chars FROM c""",
    "op3_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("text", LOWER)} AS w FROM documents),
             s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
             n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
             links AS MATERIALIZED (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
             reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x""",
    "op8_line_dedup": f"""
        WITH l AS (SELECT doc_id, i, ls[i] AS line, array_to_string(regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+'), ' ') AS k, regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+') AS w
                   FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
             f AS MATERIALIZED (SELECT k, any_value(w) AS w, min((doc_id, i)) AS first FROM l WHERE k <> '' GROUP BY k),
             v AS MATERIALIZED (SELECT k, first, p, len(w) AS n, array_to_string(list_concat(list_slice(w, 1, p - 1), list_slice(w, p + 1, len(w))), ' ') AS rest FROM (SELECT k, w, first, unnest(range(1, len(w) + 1)) AS p FROM f WHERE len(w) >= 3)),
             replaced AS (SELECT k FROM v JOIN (SELECT rest, p, n, min(first) AS top FROM v GROUP BY ALL) USING (rest, p, n) WHERE top < first),
             put AS (SELECT v.k AS long, f.k AS short, v.first AS a, f.first AS b FROM v JOIN f ON f.k = v.rest AND len(f.w) >= 3),
             near AS (SELECT k FROM replaced UNION SELECT CASE WHEN a < b THEN short ELSE long END FROM put),
             marked AS (SELECT l.*, l.k <> '' AND (n.k IS NOT NULL OR f.first <> (l.doc_id, l.i)) AS gone FROM l LEFT JOIN f USING (k) LEFT JOIN near n ON n.k = l.k)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM marked GROUP BY doc_id""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
             reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
             c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
             n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
        SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op7_mix_sources": """
        WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
             shares AS (SELECT source, n, pow(n, 0.7) AS w FROM sizes),
             rates AS (SELECT source, w / (SELECT sum(w) FROM shares) * (SELECT sum(n) FROM sizes) / n AS rate FROM shares),
             steps(source, rate, k, logp, total) AS (
                 SELECT source, rate, 0, -rate, exp(-rate) FROM rates
                 UNION ALL
                 SELECT source, rate, k + 1, logp + ln(rate) - ln(k + 1), total + exp(logp + ln(rate) - ln(k + 1)) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
             u AS (SELECT doc_id, source, text, CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS x FROM documents),
             counted AS (SELECT doc_id, u.source, text, count(s.k) AS copies FROM u JOIN steps s ON s.source IS NOT DISTINCT FROM u.source AND s.total <= u.x GROUP BY doc_id, u.source, text)
        SELECT doc_id, source, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy, CAST(copies AS INTEGER) AS copies, text FROM counted""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, sha1(body) AS payload_digest, strlen(body) AS payload_bytes FROM p),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
        FROM m""",
    "op11_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
             g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) AS t(k) WHERE len(w) >= k)),
             f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 10),
             totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
             c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
             cuts AS (SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
             scored AS (SELECT cuts.*, h.n AS l, t.n AS r, CAST((a::HUGEINT * a * 1000000) // (h.n::HUGEINT * t.n) AS BIGINT) AS score FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
             low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
             inside AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS around FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
             rows AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, totals.n AS n, score FROM rows JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op13_page_text": f"""
        WITH b AS (SELECT page_id, url, list_filter(list_transform({_BLOCKS}, lambda x: trim(regexp_replace({_PLAIN}, '[\\s\\x0B\\x{{A0}}]+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM pages),
             t AS (SELECT page_id, url, array_to_string(coalesce(blocks, []), chr(10)) AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
}
