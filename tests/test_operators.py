"""Operators on planted cases with known results."""

import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import blocks, cite, library, normalise, profile, redact, stats, summary
from inkwell.plans import catalogue
from inkwell.plans import documents as plan
from inkwell.sources import documents, tables, writers


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("x", "n"), [("it's a well-known fact", 4), ("-- x --", 1), ("", 0), ("naïve", 2)])
def test_word_count(spark, x, n):
    assert one(spark, x, tx.word_count) == n


@pytest.mark.parametrize(("category", "x", "good"), [("ppsn", "1234567T", True), ("ppsn", "1234567TA", True), ("ppsn", "0000000W", True), ("ppsn", "1234567A", False), ("ppsn", "7654321K", False), ("iban", "GB82WEST12345698765432", True), ("iban", "IE29 AIBK 9311 5212 3456 78", True), ("iban", "IE29AIBK93115212345679", False), ("card", "4111111111111111", True), ("card", "378282246310005", True), ("card", "4111111111111112", False)])
def test_checksums(spark, category, x, good):
    assert one(spark, x, lambda c: redact.valid(category, c)) is good


def spans(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {(r.category, r.surface) for r in redact.spans(redact.resolve(redact.detect(df))).collect()}


def test_detectors(spark):
    assert spans(spark, "Cork is nice") == set()
    assert spans(spark, "Mary Murphy met Mary O'Brien") == {("person", "Mary Murphy")}
    assert ("dob", "01/02/1980") in spans(spark, "born: 01/02/1980")
    assert ("account", "12345678") in spans(spark, "account no 12345678")
    assert ("eircode", "T12 AB34") in spans(spark, "at T12 AB34") and spans(spark, "at Z99 AB34") == set()


def test_redaction_leaves_no_surface(spark):
    df = spark.createDataFrame(list(catalogue.PLANTED), "doc_id long, text string")
    done = redact.apply_spans(redact.resolve(redact.detect(df)))
    assert {r.leaks for r in redact.leaks(done).collect()} == {0}


FIELDS = [
    (1, 0, "Dear Mary, Dr. John Smith met us."), (1, 1, "Later John Smith left. john smith too; Johnsmith, xJohn Smith no."), (1, 2, "call +353 86 123 4567 or a@b.ie"),
    (1, 3, "no+353 86 123 4567 / (+353 86 123 4567) A@B.IE mary Mary's"), (2, 0, "nothing John Smith"), (3, 0, None), (4, 0, ""),
]


@pytest.mark.parametrize(("mode", "want"), [
    ("mask", ["Dear X, Dr. X met us.", "Later X left. X too; Johnsmith, xJohn Smith no.", "call X or X", "noX / (X) X X X's", "nothing John Smith", None, ""]),
    ("token", ["Dear [PERSON-2], Dr. [PERSON-1] met us.", "Later [PERSON-1] left. [PERSON-1] too; Johnsmith, xJohn Smith no.", "call [PHONE-1] or [EMAIL-1]", "no[PHONE-1] / ([PHONE-1]) [EMAIL-1] [PERSON-2] [PERSON-2]'s", "nothing John Smith", None, ""]),
])
def test_a_surface_goes_from_all_fields(spark, mode, want):
    df = spark.createDataFrame([(*r, "clash") for r in FIELDS], "doc_id long, field int, text string, key string").repartition(3)
    out, found, tokens = redact.redact(df, mode)
    got = sorted((r.doc_id, r.field, r.text, r.leaks) for r in out.collect())
    assert [(d, f, t and t.replace("XXXXXXXXX", "X"), n) for d, f, t, n in got] == [(d, f, w, 0) for (d, f, _), w in zip(FIELDS, want, strict=True)]
    assert (tokens is None) == (mode == "mask")
    md = {r.doc_id: r.markdown for r in writers.redaction_markdown(out, found, tokens).collect()}
    assert "| person | 2 |" in md[1] and "0 span(s)" in md[2]
    #: Masked in their own fields only, surfaces are left elsewhere, and the report is refused.
    partly = redact.apply_spans(found, everywhere=False)
    assert [(r.doc_id, r.leaks, r.leaked) for r in redact.leaks(partly).orderBy("doc_id").collect()] == [(1, 2, ["john smith", "mary"])] + [(i, 0, []) for i in (2, 3, 4)]
    assert writers.redaction_markdown(partly, found).where("doc_id = 1").first().markdown is None
    assert redact.released(partly).where("doc_id = 1 AND text IS NOT NULL").count() == 0
    assert redact.redact(df.limit(0), mode)[0].count() == 0


def test_of_overlapping_repeats_the_longest_goes(spark):
    df = spark.createDataFrame([(1, 0, "Dr. John Smith, Dr. Smith"), (1, 1, "john smith smith john Smith")], "doc_id long, field int, text string")
    got = [r.text for r in redact.redact(df, "token")[0].orderBy("field").collect()]
    assert got == ["Dr. [PERSON-2], Dr. [PERSON-1]", "[PERSON-2] [PERSON-1] [PERSON-2]"]
    with pytest.raises(ValueError, match="mask or token"):
        redact.redact(df, "hide")


def test_long_fields_with_many_spans(spark):
    n = 3000
    df = spark.createDataFrame([(1, 0, " ".join(f"mail user{i}@host{i % 97}.com now" for i in range(n))), (1, 1, "again USER7@host7.com " * n)], "doc_id long, field int, text string")
    got = [r.text for r in redact.redact(df, categories=("email",))[0].orderBy("field").collect()]
    assert got == [" ".join(["mail XXXXXXXXX now"] * n), "again XXXXXXXXX " * n]


def test_texts_in_blocks(spark):
    from inkwell.functions import text as tx

    text = "".join(chr(0x1F600 + i % 60) if i % 7 == 0 else chr(97 + i % 26) for i in range(1500))
    df = spark.createDataFrame([(text, s, n) for s, n in ((0, 3), (255, 2), (256, 256), (100, 900), (1498, 9), (5, 0), (1500, 4))], "t string, s long, n long")
    for r in df.select("s", "n", tx.cut(tx.in_blocks(F.col("t")), F.col("s"), F.col("n")).alias("x")).collect():
        assert r.x == text[r.s : r.s + r.n]
    sums = spark.createDataFrame([(list(range(300)),), ([],)], "a array<long>").select(tx.running_sums(F.col("a")).alias("x")).collect()
    assert sums[0].x == [sum(range(i)) for i in range(300)] and sums[1].x == []
    pairs = [(0, 3), (1, 9), (2, 4), (9, 10), (12, 13), (12, 12)]
    got = spark.createDataFrame([(pairs,)], "a array<struct<s:long,e:long>>").select(tx.runs(F.col("a"), lambda x: x["s"], lambda x: x["e"]).alias("x")).first().x
    assert [[tuple(p) for p in r] for r in got] == [pairs[:3], pairs[3:4], pairs[4:]]


def test_bm25(spark):
    refs = spark.createDataFrame([(0, "solar panels convert sunlight solar energy"), (1, "wind turbines convert wind energy"), (2, "medieval castles stone walls")], "ref_id long, text string")
    passages = spark.createDataFrame([(1, "solar energy policy energy"), (2, "castles walls repair")], "passage_id long, text string")
    got = {(r.passage_id, r.ref_id): (round(r.score, 6), r.affinity) for r in cite.affinities(cite.scores(cite.bm25(passages, refs))).collect()}
    assert got == {(1, 0): (2.178941, 1.0), (1, 1): (0.940007, 0.43), (2, 2): (2.155669, 0.99)}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "x")], "g long, text string")
    assert len({r.fingerprint for r in cite.set_fingerprint(a, "g", F.col("text")).collect()}) == 1


def test_profile_numbers(spark):
    df = spark.createDataFrame([(i, x, "2024-01-05", "same", None) for i, x in enumerate(["1", "2", "3", "4", "100"])], "i long, v string, d string, s string, e string")
    got = {r.column: r for r in profile.profile(df, "i").collect()}
    v = got["v"]
    assert (v.type, v.mean, v.std, v.q1, v.median, v.q3, v.outliers) == ("integer", 22.0, 43.6177, 2.0, 3.0, 4.0, 1)
    assert (got["d"].type, got["d"].pii_reason, got["d"].date_max) == ("date", "phone numbers", "2024-01-05")
    assert got["s"].constant and got["e"].type == "empty"


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert profile.correlations(profile.as_text(df, "b"), ["a", "b"]).first().r is None


def test_flattened_table_and_page_labels(spark):
    df = spark.createDataFrame(list(catalogue.PLANTED), "doc_id long, text string")
    assert sorted((r.doc_id, r.rows) for r in blocks.table_regions(df).collect()) == [(-10, 2), (-3, 2)]
    assert {(r.doc_id, r.kind) for r in blocks.page_markers(df).collect()} == {(-10, "label"), (-9, "number"), (-3, "label"), (-2, "number")}


def test_headers_and_delimiters(spark, tmp_path):
    assert tables.clean_header(["a", "a", "", "a"]) == ["a", "a_2", "column_3", "a_3"]
    assert tables.sniff("a;b;c,d") == ";" and tables.sniff("abc") == ","
    (tmp_path / "x.csv").write_text('a;b;b\n1;"x;y";3\n\n4;5\n')
    df = tables.read_delimited(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["a", "b", "b_2"] and [tuple(r) for r in df.collect()] == [("1", "x;y", "3"), ("4", "5", "")]
    (tmp_path / "x.json").write_text('{"records":[{"a":1,"b":{"c":2}}]}')
    assert tables.read_json_records(spark, str(tmp_path / "x.json")).first().asDict() == {"a": "1", "b": '{"c":2}'}
    (tmp_path / "y.json").write_text('[{"z":true,"a":null},7,{"b":[1],"z":"t"}]')
    got = tables.read_json_records(spark, str(tmp_path / "y.json"))
    assert got.columns == ["z", "a", "b"] and [tuple(r) for r in got.collect()] == [("true", "", ""), ("t", "", "[1]")]
    (tmp_path / "w.csv").write_bytes("näme;x\nü€;".encode() + "é€\n".encode("cp1252"))
    got = tables.read_delimited(spark, str(tmp_path / "w.csv"))
    assert [tuple(r) for r in got.collect()] == [("ü€", "é€")]
    assert tables.measured(df, 1).first().asDict() == {"row_count": 2, "kept": 1, "truncated": True}


def test_repairs():
    assert documents.repair("Ã¼ber CafÃ©") == "über Café" and documents.decode_bytes(b"caf\xe9\x00") == "café"
    assert documents.space_repair("Position:Senior at 14:30 delivery.Continued") == "Position: Senior at 14:30 delivery. Continued"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("plain text")
    (tmp_path / "in/b.md").write_text("# Title")
    (tmp_path / "in/c.bin").write_bytes(b"\x00\x01")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "in/d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "in/e.csv").write_bytes(b"\xff\xfe")
    (tmp_path / "in/f.txt").write_bytes(b"caf\xe9")
    (tmp_path / "in/g.txt").write_bytes(b"x" * 8191 + "é".encode())
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text) for r in documents.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got.pop("g.txt")[0] == "TXT"
    assert got == {"a.txt": ("TXT", "plain text"), "b.md": ("MD", "# Title"), "d.docx": ("DOCX", "Head\nBody")}
    info = documents.inspect(spark.read.format("binaryFile").load(str(tmp_path / "in"))).collect()
    assert {r.kind for r in info} == {"TXT", "MD", "DOCX"}


def test_markdown(spark):
    rows = spark.createDataFrame([([["a", "b|c"], ["1"]],)], "rows array<array<string>>")
    assert rows.select(writers.table_markdown(F.col("rows")).alias("m")).first().m == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    head = spark.range(1).select(writers.front_matter({"title": F.lit('x "y"')}).alias("m"))
    assert head.first().m == '---\ntitle: "x \\"y\\""\n---'
    assert one(spark, '---\na: "b"\nc: d\n---\nbody', writers.read_front_matter) == {"a": "b", "c": "d"}


def test_renumber(spark):
    assert one(spark, "3. Topic", lambda c: library.renumber(c, F.lit(2))) == "2.3 Topic"


def test_stream(spark, tmp_path):
    from inkwell.streaming import ingest

    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / f"in/{i}.txt").write_text(f"document {i} has words")
    q = ingest.drain(ingest.arrivals(spark, str(tmp_path / "in")), blocks.text_blocks, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_long_documents_are_ranked_whole(spark):
    filler = " ".join(f"u{i} v{i} w{i}." for i in range(4000))
    tail = ["Copper mines feed copper smelters.", "Copper smelters feed copper wire plants.", "Copper wire plants buy copper mines."]
    endless = "word " * 9000
    df = spark.createDataFrame([(1, filler + " " + " ".join(tail)), (2, endless)], "doc_id long, text string")
    found = summary.without_scaffold(summary.sentences(df))
    ranked = summary.text_rank(found).collect()
    assert {r.sentence for r in ranked if r.doc_id == 1 and r.rank <= 3} == set(tail)
    assert [r.rank for r in ranked if r.doc_id == 2] == [1]
    assert {r.doc_id for r in summary.lead(summary.sentences(df)).collect()} == {1, 2}
    assert {r.doc_id for r in summary.summaries(summary.text_rank(found)).collect()} == {1, 2}


def test_rank_scores():
    rng = np.random.default_rng(5)
    sets = [sorted({f"t{x}" for x in rng.zipf(1.4, rng.integers(0, 30)) if x < 500}) for _ in range(150)] + [[], ["alone"]]
    size = [np.log(max(len(s), 2)) for s in sets]
    weight = np.array([[0 if i == j else len(set(a) & set(b)) / (size[i] + size[j]) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    score, out = np.ones(len(sets)), weight.sum(axis=1)
    for _ in range(summary.ROUNDS):
        score = (1 - summary.DAMPING) + summary.DAMPING * weight @ np.where(out > 0, score / np.where(out > 0, out, 1), 0)
    for cells in (0, summary.CELLS):
        assert np.allclose(summary.rank_scores(sets, cells), score, atol=1e-9)
    assert summary.rank_scores([[]], 0).round(6).tolist() == [0.15] and len(summary.rank_scores([], 0)) == 0


def test_addresses(spark):
    address = lambda text: {x for c, x in spans(spark, text) if c == "address"}
    planted = "69 Belgard Downs\nRochestown Road Douglas Cork"
    assert address(planted) == {planted}
    assert address("lives at 12 Oak Park now") == {"12 Oak Park"} and address("a long road to Cork") == set()
    assert address("go to\nFlat over the shop, main street\nT12 AB34") == {"Flat over the shop, main street"}
    assert address("Mary Murphy\n4 the cross\nold mill lane\nT12 AB34") == {"Mary Murphy\n4 the cross\nold mill lane"}
    assert address("old mill lane\nZ99 AB34") == set()
    assert {x.strip() for x in address("John Smith\n5 Elm Tree\n")} == {"John Smith\n5 Elm Tree"}
    found = redact.resolve(redact.detect(spark.createDataFrame([(1, f"at {planted}. Mail a@b.ie")], "doc_id long, text string")))
    assert redact.apply_spans(found).first().text == "at XXXXXXXXX. Mail XXXXXXXXX"
    assert redact.apply_spans(found, redact.token_map(found)).first().text == "at [ADDRESS-1]. Mail [EMAIL-1]"
    done = redact.apply_spans(found)
    assert redact.leaks(done).first().leaks == 0 and redact.leaks(found).first().leaks == 2


def workbook(path, rows):
    cell = lambda i, j, x: f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{x}</t></is></c>'
    body = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, x) for j, x in enumerate(r) if x)}</row>' for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["", ""], ["b", "a", ""], ["1", "", "x"], ["2", "y", ""]])
    df = tables.read_workbook(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["b", "a"] and [tuple(r) for r in df.collect()] == [("1", ""), ("2", "y")]


def test_quartiles_are_exact(spark):
    rng = np.random.default_rng(2)
    sets = {"a": rng.normal(size=30_000).round(3), "b": rng.zipf(1.5, 20_000).clip(0, 10**6).astype(float), "c": np.array([3.0]), "d": np.array([1.0, 9.0]), "e": np.repeat([1.0, 2.0, 7.0], [5000, 9000, 1000])}
    width = max(map(len, sets.values()))
    rows = [(i, *(repr(float(v[i])) if i < len(v) else None for v in sets.values())) for i in range(width)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} string" for c in sets))
    got = {r.column: r for r in profile.numeric_stats(profile.as_text(df, "i"), list(sets)).collect()}
    for c, v in sets.items():
        assert np.allclose([got[c].q1, got[c].median, got[c].q3], np.quantile(v, [0.25, 0.5, 0.75]), rtol=1e-12), c
        assert got[c].n == len(v) and np.isclose(got[c].mean, v.mean())


def test_correlations_use_complete_pairs(spark):
    rows = [("1", "2", "x"), ("2", "4", "5"), ("3", None, "6"), ("4", "8", "7"), ("5", "11", "1")]
    got = {(r.a, r.b): (r.n, r.r) for r in profile.correlations(spark.createDataFrame(rows, "a string, b string, c string"), ["a", "b", "c"]).collect()}
    assert got["a", "b"][0] == 4 and np.isclose(got["a", "b"][1], np.corrcoef([1, 2, 4, 5], [2, 4, 8, 11])[0, 1])
    assert got["a", "c"][0] == 4 and got["b", "c"][0] == 3 and np.isclose(got["b", "c"][1], np.corrcoef([4, 8, 11], [5, 7, 1])[0, 1])


def test_walk_from_page_numbers(spark):
    """Four lines go above a bare number, blank ones count as steps, content and the thirteenth line stop the walk."""
    text = "one two\n\nhead a\nhead b\nhead c\nhead d\nhead e\n\n3\n\nA sentence ends.\nfoot\n4\n"
    rows = [(1, text), (2, "top" + "\n" * 11 + "x\n7\n"), (3, "far" + "\n" * 13 + "8\n"), (4, None), (5, "Run head 1\nbody one\nRun head 2\nPage 2\nRun head 3\nlast\nPage 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {(r.doc_id, r.line) for r in normalise.marked_lines(df).where("dropped").collect()}
    assert gone == {(1, x) for x in ("head b", "head c", "head d", "head e", "3", "foot", "4")} | {(2, "top"), (2, "x"), (2, "7"), (3, "8")} | {(5, x) for x in ("Run head 2", "Page 2", "Run head 3", "Page 3")}
    got = {r.doc_id: r for r in normalise.prepare(df).collect()}
    assert got[4].blocks == [] and got[4].text == "" and got[1].text == "one two\nhead a\nA sentence ends."
    assert got[5].header == "Run head 2 Run head 3" and got[3].text == "far"


def test_titles_from_furniture(spark):
    text = "Title page\nAnnual Plan of Cork 2025\nx\n\nAnnual Plan of Cork\n1 | Page\nbody text here\nAnnual Plan of Cork\n2 | Page\nmore"
    got = normalise.prepare(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.header == "Annual Plan of Cork 2025" and got.removed == ["Annual Plan of Cork", "1 | Page", "Annual Plan of Cork", "2 | Page"]


LIST = "Lead words stand here. More.\n\n1.1 Scope\n• cut costs by 12%\n• plain item\n\n1.2 Method\n• cut costs by 12%\n• hired 20 people\n• on 1/2/2020 and 3/4/2021 nothing\n"


def test_reports(spark):
    long = "The river rose by 12% in 2021. " + " ".join(f"River water number {i} flows past the old mill town." for i in range(30))
    rows = [(1, LIST), (2, long), (3, "# Head\ntext ¥"), (4, "")]
    reports = plan.document_reports(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in reports.collect()}
    assert got[1].doc_class == "list-dominant" and got[1].summary == "Lead words stand here. Defines two sections: Scope; Method."
    assert got[1].key_findings == ["hired 20 people"] and [(s.title, s.words) for s in got[1].sections] == [("1.1 Scope", 5), ("1.2 Method", 8)]
    assert got[2].doc_class == "prose" and got[2].title == "document-2" and got[2].n_phrases >= 5 and "content_loss" not in got[2].verdict_flags
    assert got[3].title == "Head" and got[3].source_type == "MD" and got[4].verdict_flags == "no_content no_summary"
    md = {r.doc_id: r.markdown for r in writers.document_markdown(reports).collect()}
    heads = lambda x: [h for h in x.split("\n") if h.startswith("## ")]
    assert heads(md[1]) == [f"## {h}" for h in ("1. Executive Summary", "2. Knowledge Score", "3. Document Metadata", "4. Quality Verdict", "5. Contents", "6. Structure", "7. Key Findings", "8. Key Phrases", "13. Statistics", "14. Full Extracted Text")]
    assert "- hired 20 people" in md[1] and "### 1.1 Scope (5 words)" in md[1] and md[1].startswith("---\ntitle: ") and "\n### Head" not in md[4]
    chosen = spark.createDataFrame([(0, 2, "Two", md[2]), (1, 1, "One", md[1])], "ord int, doc_id long, title string, markdown string")
    phrases, refs = spark.createDataFrame([("p", 2.0), ("q", 3.0)], "phrase string, score double"), spark.createDataFrame([("r1",)], "raw string")
    whole = writers.compilation_markdown("Both", chosen, phrases, refs).first().markdown
    assert whole.index("# Document 1 — Two") < whole.index("# Document 2 — One") and "## 2.4 Quality Verdict" in whole and "- q\n- p" in whole
    short = writers.compilation_markdown("Both", chosen, phrases, refs, context=True).first().markdown
    assert "## 1.4 Quality Verdict" in short and "Knowledge Score" not in short


def word_file(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_tables_and_pages_of_files(spark, tmp_path):
    para = lambda x, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{x}</w:t></w:r></w:p>'
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    grid = table([[para("name"), para("a|b")], [para(""), para("")], [para("Anna"), para("two words") + para("more")], [para("Bo")]])
    layout = table([[para("Inner head", "Heading2") + para("inner text")], [grid]])
    word_file(tmp_path / "a.docx", para("Top", "Heading1") + para("one two three") + grid + layout)
    word_file(tmp_path / "b.docx", table([[para(""), para("")]]))
    stream = b"stream\n(Short head) Tj\n(A paragraph of text that is long enough to be read by all.) Tj endstream "
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page " + stream + b"/Type /Page")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "e.txt").write_text("plain words here")
    files = documents.read_documents(spark, str(tmp_path))
    rows = [["name", "a | b"], ["Anna", "two words more"], ["Bo"]]
    got = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert [(b.type, b.text, b.level, b.rows) for b in got["a.docx"].source_blocks] == [
        ("heading", "Top", 1, None), ("paragraph", "one two three", None, None), ("table", None, None, rows), ("heading", "Inner head", 2, None), ("paragraph", "inner text", None, None), ("table", None, None, rows),
    ]
    assert got["b.docx"].source_blocks == [] and (got["c.pdf"].pages, got["d.pdf"].pages, got["e.txt"].pages) == (2, 1, None)
    reports = plan.file_reports(files)
    seen = {r.path.rsplit("/", 1)[1]: r for r in reports.collect()}
    a = seen["a.docx"]
    assert (a.doc_class, a.source_type, a.pages, a.n_tables, a.title) == ("form", "DOCX", "n/a (flowed format)", 2, "Inner head")
    assert [(s.title, s.words) for s in a.sections] == [("Top", 3 + 8), ("Inner head", 2 + 8)] and a.word_count == 2 * 8 + 8
    assert any("2 table(s)" in n for n in a.notes) and not any("Tables" in n for n in a.notes)
    assert (seen["b.docx"].doc_class, seen["b.docx"].n_tables, seen["c.pdf"].pages, seen["c.pdf"].source_type, seen["e.txt"].source_type) == ("prose", 0, "2", "PDF", "TXT")
    md = {r.doc_id: r.markdown for r in writers.document_markdown(reports).collect()}[a.doc_id]
    assert md.count("| name | a \\| b |\n| --- | --- |\n| Anna | two words more |\n| Bo |  |\n") == 2
    fields = redact.fields_of(normalise.prepare(files.withColumn("doc_id", F.col("path")))).where("endswith(doc_id, 'a.docx')").orderBy("field").collect()
    assert fields[2].text == "name\na | b\nAnna\ntwo words more\nBo"


def test_findings_from_cells(spark):
    given = [("heading", "One", 1, None), ("list", "plain", None, None), ("list", "other", None, None), ("heading", "Two", 1, None), ("list", "third", None, None), ("list", "fourth", None, None), ("table", None, None, [["costs", "rose by 12%"], ["staff", "20 people left. They were paid."]])]
    df = spark.createDataFrame([(1, "x", "DOCX", given)], f"doc_id long, text string, kind string, source_blocks {normalise.SOURCE_BLOCKS}")
    r = plan.document_reports(df).first()
    assert r.doc_class == "list-dominant" and r.key_findings == ["rose by 12%", "20 people left."]


def test_pdf_paragraphs_where_no_line_stays(spark):
    df = spark.createDataFrame([(1, "1 | Page\n2 | Page", "PDF"), (2, None, "PDF"), (3, "# Head", None)], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in normalise.prepare(df).collect()}
    assert [(b.type, b.text) for b in got[1].blocks] == [("heading", "1 | Page\n2 | Page")] and got[1].source_type == "PDF"
    assert got[2].blocks == [] and got[3].source_type == "MD"


def test_correlation_square(spark):
    df = spark.createDataFrame([(i, str(i), str(2 * i), str((-1) ** i), "5") for i in range(10)], "id int, a string, b string, c string, d string")
    pairs = profile.correlations(profile.as_text(df, "id"), ["a", "b", "c", "d"])
    got = {r["column"]: tuple(r)[1:] for r in profile.matrix(pairs, ["a", "b", "c", "d"]).collect()}
    assert got["a"] == (1.0, 1.0, -0.17, None) and got["d"] == (None, None, None, 1.0) and got["c"][0] == got["a"][2]
    assert profile.matrix(pairs.limit(0), ["a"]).count() == 0


def test_index_of_the_library(spark, tmp_path):
    from inkwell.sources import index

    rows = [(1, "Café culture", "The entry. the end"), (2, "CAFE", None), (3, None, "Enter été_1 x"), (4, "", "Straße naïve"), (5, "theory", "nothing")]
    reports = spark.createDataFrame([(*r, "clash") for r in rows], "id long, title string, excerpt string, term string")
    path = str(tmp_path / "index")
    index.write(reports.where("id < 4"), path, files=3)
    index.write(reports.where("id >= 4"), path)
    held = index.read(spark, path)
    for query in ("cafe", "CAFÉ ent", "the", "the x", "été", "e", "naive", "straße", "zzz", "!", "", "the the ent", "nothing the"):
        got = sorted(r.report_id for r in index.search(held, query).collect())
        assert got == sorted(r.id for r in library.search(reports, query).collect()), query
    assert {r.report_id: r.hits for r in index.search(held, "the ent").collect()} == {1: 3, 3: 1}
    assert [r.report_id for r in index.search(held, "cafe", field="title").orderBy("report_id").collect()] == [1, 2]
    plan_of = lambda q: index.search(held, q)._jdf.queryExecution().toString()
    assert "PartitionFilters: [head" in plan_of("cafe ent") and "StringStartsWith(term,ent)" in plan_of("ent")
    files = index.search(held, "cafe").inputFiles()
    assert index.search(held, "zzz").count() == 0 and len(files) >= 1
    index.write(reports.limit(0), str(tmp_path / "none"))
    assert index.search(index.read(spark, str(tmp_path / "none")), "a").count() == 0 if (tmp_path / "none").exists() else True


def test_dataset_report(spark):
    rows = [(i, float(i), 2.0 * i, "a@b.ie" if i % 2 else None, "x") for i in range(40)] + [(0, 0.0, 0.0, None, "x")]
    df = spark.createDataFrame(rows, "id long, v double, w double, mail string, one string")
    text, cols = profile.as_text(df, "id"), df.columns
    whole, dups, pairs = profile.profile(df, "id"), profile.duplicates(text, cols), profile.correlations(text, ["v", "w"])
    found = profile.findings(whole, pairs, dups)
    said = [r.finding for r in found.orderBy("g", "k").collect()]
    assert said[0] == "v and w move together, r = 1.0" and "mail is missing in 51.2% of rows" in said and "one holds one value" in said and said[-1] == "1 rows repeat others"
    judged = profile.verdict(whole, dups).first()
    assert judged.flags == ["pii", "duplicates"] and "mail (email addresses)" in judged.issues[0]
    assert profile.overview(whole, 10).first().truncated
    md = writers.dataset_markdown("T", whole, profile.score(profile.counts(text, cols), profile.types(text, cols), dups), pairs, found, profile.verdict(whole, dups)).first().markdown
    assert [h for h in md.split("\n") if h.startswith("## ")] == [f"## {h}" for h in ("1. Overview", "2. Knowledge Score", "3. Dataset Metadata", "4. Quality Verdict", "5. Key Findings", "6. Column Profile", "7. Correlation Matrix")]


def test_passages(spark):
    words = " ".join(f"w{i}" for i in range(250))
    rows = [(1, "# One\nfirst text\nsecond\n# Empty\n# Two\nlast"), (2, words), (3, ""), (4, "intro\n# Head\nbody #")]
    got = [(r.doc_id, r.passage, r.label, r.text) for r in cite.passages(normalise.prepare(spark.createDataFrame(rows, "doc_id long, text string"))).orderBy("doc_id", "passage").collect()]
    assert got[:2] == [(1, 0, "One", "first text second"), (1, 1, "Two", "last")]
    assert [(x[2], len(x[3].split())) for x in got if x[0] == 2] == [("Passage 1 of 3", 120), ("Passage 2 of 3", 120), ("Passage 3 of 3", 10)]
    assert [x[1:] for x in got if x[0] == 4] == [(0, "Preamble", "intro"), (1, "Head", "body #")] and not [x for x in got if x[0] == 3]


def test_citation_report(spark):
    passages = spark.createDataFrame([(1, "P1", "solar energy policy energy"), (2, "P2", "castles walls repair")], "passage_id long, title string, text string")
    refs = spark.createDataFrame([(0, "solar panels convert sunlight solar energy"), (1, "wind turbines convert wind energy"), (2, "medieval castles stone walls")], "ref_id long, text string")
    parts = cite.bm25(passages, refs)
    matched = cite.matches(cite.affinities(cite.scores(parts)))
    suited = cite.ranked(cite.suitability(matched))
    assert [r.ref_id for r in suited.collect()] == [0, 2, 1]
    names = spark.createDataFrame([(0, "Sun"), (1, "Wind"), (2, "Stone")], "ref_id long, name string")
    md = writers.citation_markdown("Work", passages, matched, cite.evidence(parts, matched), suited, names).first().markdown
    assert "| Sun | 100% | 1 |" in md and md.index("### P1") < md.index("### P2") and "- Stone (0.99, great): castles walls" in md


def test_redaction_report(spark):
    prepared = spark.createDataFrame([(1, "x", [("mail a@b.ie",), ("to a@b.ie",)]), (2, "c@d.ie", [])], "doc_id long, text string, blocks array<struct<text:string>>")
    fields = redact.detect(redact.fields_of(prepared))
    assert sorted((r.doc_id, r.field, len(r.spans)) for r in fields.collect()) == [(1, 0, 1), (1, 1, 1), (2, 0, 1)]
    found = redact.resolve(redact.detect(spark.createDataFrame([(1, "mail a@b.ie, c@d.ie")], "doc_id long, text string")))
    tokens = redact.token_map(found)
    md = writers.redaction_markdown(redact.apply_spans(found, tokens), found, tokens).first().markdown
    assert "| email | 2 |" in md and "mail [EMAIL-2], [EMAIL-1]" in md and "| [EMAIL-1] | c@d.ie |" in md


def test_library_deletes_with_children(spark, tmp_path):
    reports = spark.createDataFrame([(1, "j1"), (2, "j2")], "id long, job_id string")
    writers.write_library(reports, spark.createDataFrame([(1, "p"), (2, "q"), (2, " ")], "report_id long, phrase string"), spark.createDataFrame([(2, "r")], "report_id long, raw string"), str(tmp_path / "a"))
    writers.delete_reports(str(tmp_path / "a"), spark.createDataFrame([(2,)], "report_id long"), str(tmp_path / "b"))
    assert [spark.read.parquet(str(tmp_path / f"b/{t}")).count() for t in ("reports", "keyphrases", "references")] == [1, 1, 0]
    assert [r.id for r in library.by_job(reports, spark.createDataFrame([("j2",), ("j2",)], "job_id string")).collect()] == [2]


def test_phrases_merge_across_accents(spark):
    df = spark.createDataFrame([("Café", 1.0), ("cafe", 2.0), ("tea", 2.5)], "phrase string, score double")
    assert [tuple(r) for r in library.merge_keyphrases(df).collect()] == [("cafe", 3.0), ("tea", 2.5)]


def test_small_columns(spark):
    found = [("paragraph", "x"), ("heading", "3."), ("heading", " "), ("heading", "Real one")]
    df = spark.createDataFrame([(found, "PDF", 3)], "b array<struct<type:string,text:string>>, k string, n int")
    r = df.select(blocks.short_title(F.col("b"), F.lit("stem")).alias("t"), blocks.short_title(F.slice("b", 1, 3), F.lit("stem")).alias("s"), blocks.pages_shown(F.col("k"), F.col("n")).alias("p"), blocks.page_list(F.col("n")).alias("l")).first()
    assert tuple(r) == ("Real one", "stem", "3", [1, 2, 3])
    shown = lambda k: one(spark, k, lambda c: blocks.pages_shown(c, F.lit(1)))
    assert shown("CSV") == "n/a (dataset)" and shown("MD") == "n/a (flowed format)"
    size = lambda n: one(spark, n, tx.format_bytes, "long")
    assert [size(n) for n in (12, 2048, 3 << 20)] == ["12 B", "2 KB", "3.0 MB"]


def test_name_lists(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# list\nTove\n\nada\n")
    first = redact.read_names(spark, str(tmp_path / "names.txt"))
    assert first == ("ada", "tove")
    df = spark.createDataFrame([(1, "then Tove Jansson met Mary Murphy")], "doc_id long, text string")
    got = redact.spans(redact.detect(df, ("name",), first, ("jansson",))).collect()
    assert [r.surface for r in got] == ["Tove Jansson"]
    with pytest.raises(ValueError):
        redact.read_names(spark, str(tmp_path / "names.txt"), limit=1)


def test_reports_are_registered_once(spark, tmp_path):
    from inkwell.streaming import ingest

    source, library_at, checkpoint = str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / "check")

    def arrive(rows):
        df = spark.createDataFrame(rows, "id long, fingerprint string, t string, title string").select("id", "fingerprint", F.to_timestamp("t").alias("created_at"), "title")
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        q = ingest.register(spark.readStream.schema("id long, fingerprint string, created_at timestamp, title string").parquet(source), library_at, checkpoint)
        assert q.awaitTermination(120)
        told = sorted((r.id, r.earliest, r.latest) for r in spark.read.parquet(f"{library_at}/decisions").collect())
        return told, sorted(r.id for r in spark.read.parquet(f"{library_at}/reports").collect()), q

    arrive([(1, "a", "2024-01-01 10:00:00", "x"), (2, "a", "2024-01-01 10:10:00", "x"), (3, "b", "2024-01-01 10:20:00", None)])
    told, held, _ = run()
    assert {r[1:] for r in told} == {(None, None)} and len(held) == 2 and 3 in held
    first = (set(held) - {3}).pop()
    arrive([(4, "b", "2024-01-01 10:40:00", "y"), (5, "c", "2024-01-02 09:00:00", "y")])
    told, held, _ = run()
    assert sorted(r[0] for r in told) == sorted([first, 3, 5]) and 5 in held  # 4 is known to the state
    arrive([(6, "b", "2024-01-03 12:00:00", "z"), (7, "d", "2024-01-03 12:00:00", "z")])
    told, held, q = run()
    assert (6, 3, 3) in told and (7, None, None) in told and 6 not in held and 7 in held  # long after, the library knows it
    removed = sum(p["numRowsRemoved"] for x in q.recentProgress for p in x["stateOperators"])
    assert removed >= 1, removed  # what is older than the watermark leaves the state
    #: The last batch wasn't marked as done: it runs again and writes the same.
    last = max((tmp_path / "check/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run()[:2] == (told, held)


def test_windowed_counts(spark):
    from inkwell.streaming import ingest

    events = spark.createDataFrame([("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:55:00", "a", 2.0), ("2024-01-01 11:01:00", "a", 4.0)], "t string, event_type string, value double")
    got = ingest.windowed_counts(events.withColumn("ts", F.to_timestamp("t"))).collect()
    assert sorted((r.n, r.total) for r in got) == [(1, 4.0), (2, 3.0)]


def test_paragraph_blocks(spark):
    got = spark.createDataFrame([("HEAD\n\n A line.\nsame\n \n" + "x" * 120,)], "t string").select(blocks.paragraph_blocks(F.col("t")).alias("b")).first().b
    assert [(b.type, b.level) for b in got] == [("heading", 2), ("heading", 2), ("paragraph", None)]


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sentences_are_ranked_and_paired_in_their_rows(spark):
    df = spark.createDataFrame([(1, "One red fox. Note: a fox ran. Note: it ran on. A red dog sat. The dog and fox met. Red dogs ran."), (2, ""), (3, None), (4, "Alone. Alone."), (5, "Twice: x. Twice: y. Only this.")], "doc_id long, text string")
    plain = summary.plain_sentences(df)
    found = summary.without_scaffold(summary.sentences(df))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(plain.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")) == rows(found)
    ranked = summary.in_rows(summary.ranked_sentences(plain))
    assert rows(ranked) == rows(summary.text_rank(found)) and {r.doc_id for r in ranked.collect()} == {1, 4, 5}
    pairs = summary.pair_weights(plain)
    assert rows(pairs) == rows(summary.pair_weights(summary.gathered(found))) and pairs.where("doc_id = 1").count() > 3
    assert {r.doc_id for r in summary.summaries_of(summary.ranked_sentences(plain)).collect()} == {1, 4, 5}
    assert [shuffles(x) for x in (ranked, pairs, summary.summaries_of(summary.ranked_sentences(plain)))] == [0, 0, 0]


def test_pairs_are_the_same_in_any_steps():
    rng = np.random.default_rng(1)
    lists = pa.array([[[f"w{t}" for t in rng.choice(30, k, replace=False)] for k in rng.integers(0, 6, n)] for n in (0, 7, 1, 25)])
    want = {(d, i, j): len(set(x) & set(y)) for d, doc in enumerate(lists.to_pylist()) for i, x in enumerate(doc) for j, y in enumerate(doc) if i < j and set(x) & set(y)}
    for at_once in (1, 10, 10_000):
        got = {(d, i, j): w for part in summary.pair_counts(lists, at_once) for d, i, j, w in zip(*(x.tolist() for x in part), strict=True)}
        assert got.keys() == want.keys()
        size = lambda d, i: np.log(max(2, len(lists[d][i])))
        assert all(np.isclose(w, want[k] / (size(k[0], k[1]) + size(k[0], k[2]))) for k, w in got.items())


def test_key_phrases_are_found_in_their_rows(spark):
    df = spark.createDataFrame([(1, "Red fox runs. The red fox and a dog; dog of blue hills, blue hills. " + "x" * 90 + " " + ", ".join(f"p{chr(97 + i)}" for i in range(20))), (2, ""), (3, None), (4, "the of and"), (5, "ab")], "doc_id long, text string")
    found = stats.rake(df)
    got = [(r.doc_id, r["rank"], r.phrase, r.score) for r in found.orderBy("doc_id", "rank").collect()]
    assert got[:5] == [(1, 1, "red fox runs", 8.0), (1, 2, "red fox", 5.0), (1, 3, "blue hills", 4.0), (1, 4, "dog", 1.0)] and len(got) == 4 and shuffles(found) == 0
    many = spark.createDataFrame([(1, ", ".join(f"word{i:02d}z" for i in reversed(range(40))))], "doc_id long, text string")
    assert [r.phrase for r in stats.rake(many).orderBy("rank").collect()] == [f"word{i:02d}z" for i in range(15)]


def test_terms_are_counted_in_their_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c"])], "id long, w array<string>")
    assert [[tuple(x) for x in r.c] for r in df.orderBy("id").select(cite.counted(F.col("w")).alias("c")).collect()] == [[("a", 1), ("b", 2)], [], [("c", 1)]]
    passages = spark.createDataFrame([("p1", "solar energy policy energy"), ("p2", "castles walls repair")], "passage_id string, text string")
    refs = spark.createDataFrame([("r0", "solar panels convert sunlight solar energy"), ("r1", "wind turbines convert wind energy"), ("r2", "medieval castles"), ("r2", "stone walls castles"), ("r3", None)], "ref_id string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = cite.bm25(passages, refs)
        rows = lambda x: sorted((r.passage_id, r.ref_id, r.term, round(r.contribution, 9)) for r in x.collect())
        #: References are dealt once (and read from there for document frequencies), not again for terms or pairs.
        plan = cite.scores(parts)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(passage_id" not in plan.split("HashAggregate(keys=[passage_id", 2)[1].split("BroadcastHashJoin")[0]
        near = rows(parts)
        monkeypatch.setattr(cite.near, "__defaults__", (-1,))
        assert near == rows(cite.bm25(passages, refs)) and {(r[1], r[2]) for r in near} == {("r0", "solar"), ("r0", "energy"), ("r1", "energy"), ("r2", "castles"), ("r2", "walls")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    #: A reference of two rows is one text.
    one = cite.bm25(passages, refs.where("ref_id <> 'r2'").unionByName(spark.createDataFrame([("r2", "medieval castles stone walls castles")], "ref_id string, text string")))
    assert {r[1:3]: r[3] for r in rows(one) if r[1] == "r2"}.keys() == {r[1:3]: r[3] for r in near if r[1] == "r2"}.keys()


def test_every_pattern_is_tried_only_where_its_hints_hold(spark):
    assert len(redact.NEEDED) == len(redact.PATTERNS)
    street, near = "Mary Murphy \n 69A Belgard Downs \n Cork Road", "Mr. X Y\n12 Oak Lane\nT12 AB34"
    said = ("1234567T", "gb82west12345698765432", "4111-1111 1111 1111", "ie7654321a", "t23xy12", "a.b@c.org", "+353861234567", "021 490 3000", "born 1 May 1990", "BIC: 12345678", "Mrs Ada Byrne", "Dear\tMary", "Cc:Anna", "Mary  O'Brien",
            street, "9 Oak\nRoad", "12 Oak Park", "Oak's Hill Green", near, "nothing here", "Road", "Mary Oak", None)
    rows = catalogue.docs(spark, "/root/testdata/sf0.001").select("text").unionByName(spark.createDataFrame([(x,) for x in said], "text string")).cache()
    text = F.col("text")
    for (category, _, pattern, _), needed in zip(redact.PATTERNS, redact.NEEDED, strict=True):
        hinted = F.lit(True)
        for h in needed:
            hinted = hinted & redact.holds(text, redact.HINTS[h])
        n = rows.select(F.count_if(text.rlike(pattern)).alias("met"), F.count_if(text.rlike(pattern) & ~hinted).alias("lost"), F.count_if(~hinted).alias("spared")).first()
        assert n.met and not n.lost and n.spared, (category, pattern, n)


def test_first_values_are_taken_without_sorting_a_table(spark):
    rows = [(i // 2, None if i % 3 else f"v{i:03d}", "" if i < 50 else str(i)) for i in reversed(range(100))]
    text = profile.as_text(spark.createDataFrame(rows, "k long, a string, b string"), "k")
    first = profile.first_values(text, ["a", "b"], 5)
    got = sorted((r.column, r["_row"], r.value) for r in first.collect())
    assert got == [("a", 0, "v000"), ("a", 1, "v003"), ("a", 3, "v006"), ("a", 4, "v009"), ("a", 6, "v012")] + [("b", 25 + i // 2, str(50 + i)) for i in range(5)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2 and "Window" not in plan


def test_lines_are_cleaned_in_tasks_that_grow_in_number(spark):
    for n in (2, 6):
        df = spark.range(12).repartition(n).select(F.col("id").alias("doc_id"), F.lit("1 | P a g e\none\ntwo").alias("text"))
        plan = normalise.clean_blocks(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and f"Exchange hashpartitioning(doc_id#" in plan and f", {normalise.SHARES * n}), REPARTITION_BY_NUM" in plan
