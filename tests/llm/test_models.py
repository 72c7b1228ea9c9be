"""SentencePiece against its library, the language model against a plain trie, the pipeline on a small folder."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkwell.llm import pieces, ppm

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "  two  spaces ", "\n\n\t x", "a" * 500, "日本語 テスト 🎉", "▁x▁▁y", "a\0b \0", "</s> <s> <unk>", "naïve café   "]
    texts += ["".join(rng.choices(["the ", "ing", "un", "é", "x", " ", "12", ".\n", "Über"], k=rng.randint(1, 400))) for _ in range(60)] + ["long text " * 20_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    vocabulary = pieces.Vocabulary.load(MODEL)
    out = pieces.encode(df, vocabulary)
    got = {r.doc_id: r for r in out.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode(t or ""), i
        assert got[i].restored and got[i].n_tokens == len(got[i].ids)
    back = {r.doc_id: r.text for r in pieces.decode(out, vocabulary).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode(df.limit(0), vocabulary).count() == 0


def test_suffix_array():
    codes = np.frombuffer("banana$".encode("utf-32-le"), np.uint32)
    assert pieces.suffix_array(codes, 8).tolist() == [6, 5, 3, 1, 0, 4, 2]


def gram_value(gram, seen):
    context, s, excluded, total = gram[:5], gram[5], set(), 0.0
    for k in range(5, -1, -1):
        left = {a: c for a, c in seen.get(context[5 - k :], {}).items() if a not in excluded}
        if left:
            twice = 2 * sum(left.values())
            if s in left:
                return total + math.log10((2 * left[s] - 1) / twice)
            total += math.log10(len(left) / twice)
            excluded |= left.keys()
    return total - math.log10(256 - len(excluded))


@pytest.mark.parametrize("chunk", [3000, 10**9])
def test_language_model(spark, chunk, monkeypatch):
    monkeypatch.setattr(ppm.Tally.__init__, "__defaults__", (50,))
    monkeypatch.setattr(ppm, "WORDS", 3)
    rng = random.Random(6)
    texts = {i: " ".join(rng.choices(["The", "cat", "sat", "ß", "on", "mat.", "zq" * 9], k=rng.randint(0, 60))) for i in range(60)} | {100: None, 101: "", 102: "word " * 4000}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, score int").repartition(4)
    got = {r.doc_id: r for r in ppm.score(df, chunk_bytes=chunk).collect()}
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower() if (t or "").isascii() else (t or "").encode().translate(ppm.LOWER)) + [b"\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    seen = defaultdict(Counter)
    coded = {i: b"\n" * 5 + ppm.coded(t) for i, t in tokens.items()}
    for i, x in coded.items():
        if not held[i]:
            for p in range(5, len(x)):
                for k in range(6):
                    seen[x[p - k : p]][x[p]] += 1
    for i, x in coded.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]), rel_tol=1e-9)
        assert math.isclose(r.score, sum(gram_value(x[p - 5 : p + 1], seen) for p in range(5, len(x))), rel_tol=1e-9), i
    assert ppm.score(df.limit(0)).count() == 0


def test_language_model_of_odd_rows(spark):
    """Ids of other types, null ids, repeated rows and no training text at all."""
    rows = [("a", "the cat"), ("a", "the cat"), (None, "the cat"), ("b", None)]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, round(r.score, 9)) for r in ppm.score(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=repr)
    assert [g[0] for g in got] == ["a", "a", "b", None] and len({g[3] for g in got if g[0] != "b"}) == 1 and got[2][2] == 1
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = ppm.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert alone.held_out and alone.train_tokens == 0 and math.isclose(alone.score, -3 * math.log10(256))
    assert ppm.score_adaptive(spark.createDataFrame(rows, "doc_id string, text string")).count() == 4


def test_held_out_texts_are_predicted(spark):
    """A model that has learned the words beats an even guess by far on texts it hasn't seen."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["river", "stone", "light", "water", "field"], k=40))) for i in range(200)]
    got = [r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert got and all(r.score > -2.0 * r.n_tokens for r in got)


def test_language_model_packs_what_chunks_share(spark, monkeypatch):
    """Tables between steps have a row for a chunk and a part, not one for each gram and word; odd spaces, slices of few
    texts and of few bytes, and counts that are handed on early change nothing."""
    rows = {}

    class Watched(ppm.Workspace):
        def cut(self, df, *codec):
            out = super().cut(df, *codec)
            rows[len(rows)] = out.count()
            return out

    monkeypatch.setattr(ppm, "Workspace", Watched)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(500)]
    texts = [None, "", " \t\r\n\x0b\x0c ", "\x00\x1c a\x85b \u00a0 ", " A  a\n\nA\t"] + ["".join(w + rng.choice([" ", "\n", " \t ", "  "]) for w in rng.choices(words, k=rng.randint(0, 200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    size = sum(len((t or "").encode()) + 1 for t in texts)
    got = {r.doc_id: r for r in ppm.score(df, chunk_bytes=size // 3).collect()}
    #: One row for the words and one for the grams of each of at most four chunks and as many parts.
    assert rows and max(rows.values()) <= 2 * 4 * 4
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(ppm.LOWER)) for i, t in enumerate(texts)}
    coded = {i: b"\n" * 5 + b" ".join(t) + b"\n" for i, t in tokens.items()}
    seen, train = defaultdict(Counter), [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    for x in (coded[i] for i in train):
        for p in range(5, len(x)):
            for k in range(6):
                seen[x[p - k : p]][x[p]] += 1
    counts = Counter(w for i in train for w in [*tokens[i], b"\n"])
    n, v = sum(counts.values()), len(counts)
    for i, x in coded.items():
        r, own = got[i], [*tokens[i], b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isclose(r.score, sum(gram_value(x[p - 5 : p + 1], seen) for p in range(5, len(x))), rel_tol=1e-9), i
    for name, value in (("AT_ONCE", 300), ("ROWS", 2), ("TEXTS", 3), ("WORDS", 5)):
        monkeypatch.setattr(ppm, name, value)
    monkeypatch.setattr(ppm.Tally.__init__, "__defaults__", (20,))
    again = {r.doc_id: r for r in ppm.score(df, chunk_bytes=size // 3).collect()}
    assert len(again) == len(got)
    for i, r in got.items():
        assert again[i][:5] == r[:5] and math.isclose(again[i].base_score, r.base_score, rel_tol=1e-12) and math.isclose(again[i].score, r.score, rel_tol=1e-12)


def test_adaptive(spark):
    rows = [(1, "abc abc abc abc abc abc"), (2, None), (3, "q")]
    got = {r.doc_id: r.score for r in ppm.score_adaptive(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] > -2.408 * 24 and math.isclose(got[2], -math.log10(256)) and got[3] < got[2]


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    words = "the of and river stone light water field tree house walks runs sings under over green blue small great".split()
    sentence = lambda: " ".join(rng.choices(words, k=12)).capitalize() + "."
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(sentence() for _ in range(8)), "en", f"s{i % 3}", 1))
    rows += [(100, rows[0][1], "en", "s0", 1), (101, "too short", "en", "s1", 1), (102, None, "en", None, 1), (103, "a b c d e f g h " * 20, "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in pipeline.STAGES[:3]:
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == docs.columns, name
        path = str(tmp_path / name)
        done.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = {r.doc_id for r in docs.collect()}
    clean = set(range(40))
    assert out["quality_rules"] == clean | {100}
    assert out["line_dedup"] == clean and out["ngram_jaccard"] == clean
    last = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} <= clean and all(r.restored for r in last)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, a null source and clashing names through every stage; then empty tables."""
    pipeline = pytest.importorskip("corpus_pipeline")
    fine = "The river is wide and the water of the river was clear. It is the end of that road for us, and that was good as it was."
    other = "The house on the hill was old and its doors were shut. A man with a hat walked to it, and that is all that the story says of him."
    third = "In the morning the light of the sun was on the field and the trees, and a bird sang to the day that had come with all of its work."
    names = ["_k1", "_key", "n_lines", "_drops", "copies", "_source"]
    rows = [(1, fine, "a"), (1, fine, "a"), (None, other, None), (None, other, None), (4, None, "b"), (5, "", "b"), (6, "short text", "a"), (7, third, "b"), (None, third, "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", s, 1, *(f"{n} {t}" for n in names)) for i, t, s in rows], schema)
    wanted = {"quality_rules": [(1, fine)] * 2 + [(None, other)] * 2 + [(7, third), (None, third)], "line_dedup": [(1, fine)] * 2 + [(None, other)] * 2 + [(None, third)], "ngram_jaccard": [(1, fine), (None, other), (None, third)]}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if name in wanted:
            assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(wanted[name], key=repr)
        if name != "sentencepiece":
            assert [f.name for f in docs.schema] == schema.replace("`", "").replace(" long", "").replace(" string", "").split(", ")
            assert all(r[n] == f"{n} {r.text}" for r in got for n in names if name != "line_dedup" or r.text in (fine, other, third))
    assert all(r.restored for r in got) and {r.doc_id for r in got} <= {1, None}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
