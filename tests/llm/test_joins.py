"""Near-duplicate joins, line dedup, mixing and the archive against brute force, with odd inputs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from inkwell.llm import lines, mixing, nearjoin, nearvec, warc
from inkwell.llm.common import Workspace, connected_components

WORD = r"[^\x20\x09-\x0D]+"


class Forest(dict):
    def find(self, x):
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    out = {0: None, 1: "", 2: " \n ", 3: "one", 4: "One", 5: "two words", 6: "a b c d e", 7: "A B C D E", 8: " ".join(rng.choices(vocabulary, k=6000))}
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.choice([7, 30, 90, 400]))
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out[len(out) + 100] = " ".join(t)
    out[7000] = out[8]
    return out


def test_ngram_join(spark):
    texts = corpus(random.Random(5))
    sets = {}
    for i, t in texts.items():
        w = re.findall(WORD, (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    forest = Forest((i, i) for i in texts)
    ids = list(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.union(a, b)
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_shingles int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), forest.find(i)) for i in ids}
    twice = nearjoin.near_duplicates(df.union(df)).collect()
    assert len(twice) == 2 * len(ids) and {r.doc_id: (r.n_shingles, r.component_id) for r in twice} == got
    assert nearjoin.near_duplicates(df.limit(0)).count() == 0


def test_ngram_join_of_rows_without_id(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, a), (None, b), (4, a), (5, a), (None, None), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nearjoin.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, 4), (None, 2, None), (4, 2, 4), (5, 2, 4), (None, 0, None), (None, 2, None)], key=repr)


def test_bit_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 900), np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**64, rng.integers(0, 300), np.uint64))))
        apart = sum(int(x).bit_count() for x in (nearjoin.bit_sketch(a) ^ nearjoin.bit_sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and (len(a) > 400 or len(b) or apart)


def test_band_bounds():
    for size in range(1, 3000):
        band = int(np.searchsorted(nearjoin.BANDS, size))
        assert size * 5 // 4 <= nearjoin.BANDS[band + 1]
        for other in range(size, size * 5 // 4 + 1):
            common = -(-4 * (size + other) // 9)
            assert size + other - 2 * common <= min(nearjoin.differ(int(nearjoin.BANDS[band])), other // 4)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        center = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 20))):
            rows.append((center + rng.normal(size=16) * rng.uniform(0, 0.45)).astype(np.float32))
    rows += [rows[0], rows[0] * 2, np.zeros(16, np.float32)]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [1.0, 2.0]), (905, [1.0, 2.1])]
    df = spark.createDataFrame([(i, v, 3) for i, v in data], "vec_id long, embedding array<float>, label int").repartition(5)
    for tile in (8192, 7):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nearvec.near_duplicates(df, tile=tile).collect()}
        forest, links = Forest((i, i) for i, _ in data), defaultdict(int)
        good = {i: np.array(v, np.float32).astype(float) for i, v in data if v and None not in v and np.isfinite(v).all() and any(v)}
        for a in good:
            for b in good:
                if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9:
                    forest.union(a, b)
                    links[a] += 1
                    links[b] += 1
        assert got == {i: (links[i], forest.find(i), forest.find(i) == i) for i, _ in data}
    assert nearvec.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nearvec.near_duplicates(odd).collect()), key=repr)
    assert got == sorted([(None, 0, None, None), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def one_edit(a, b):
    i = j = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    return abs(len(a) - len(b)) <= 1 and i + j >= max(len(a), len(b)) - 1


@pytest.mark.parametrize("long", [4, 9, lines.LONG])
def test_lines(spark, monkeypatch, long):
    monkeypatch.setattr(lines, "LONG", long)
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(40)]
    pool = [rng.choices(vocabulary, k=rng.choice([1, 3, 4, 8, 9, 12, 30])) for _ in range(30)]
    docs = {-1: None, -2: "", -3: "\n\n \n", -4: " ".join(vocabulary * 30)}
    for i in range(60):
        ls = []
        for _ in range(rng.randint(1, 9)):
            t = list(rng.choice(pool))
            kind = rng.random()
            if kind < 0.2:
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            elif kind < 0.3:
                t.insert(rng.randint(0, len(t)), rng.choice(vocabulary))
            elif kind < 0.4 and len(t) > 1:
                del t[rng.randrange(len(t))]
            ls.append("  " * rng.randint(0, 1) + " ".join(t))
        docs[i] = "\n".join(ls)
    first = {}
    for i in sorted(docs):
        for p, x in enumerate((docs[i] or "").split("\n")):
            w = tuple(re.findall(WORD, x))
            if len(w) >= lines.MIN_WORDS:
                first.setdefault(w, (i, p))
    near = {a for a in first if len(a) >= lines.NEAR_WORDS and any(len(b) >= lines.NEAR_WORDS and b != a and first[b] < first[a] and one_edit(a, b) for b in first)}
    names = ["k1", "_k1", "K2", "h1", "_id", "_text", "_drops", "pos", "first", "n_lines"]
    df = spark.createDataFrame([(i, t, *(f"{n} {i}" for n in names)) for i, t in docs.items()], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    out = lines.dedup_lines(df)
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(r[n] == f"{n} {i}" for i, r in got.items() for n in names if n != "n_lines")
    for i, t in docs.items():
        out = []
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)
        for p, x in enumerate((t or "").split("\n")):
            w = tuple(re.findall(WORD, x))
            if not (len(w) >= lines.MIN_WORDS and (w in near or first[w] != (i, p))):
                out.append(x)
        assert got[i].text == (None if t is None else "\n".join(out)), i
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_very_long_lines(spark):
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    replaced, without, swapped, two = [*w[:7000], "other", *w[7001:]], [*w[:9999], *w[10_000:]], [w[1], w[0], *w[2:]], ["x", *w[1:-1], "y"]
    docs = [w, replaced, without, swapped, two, [*w, "end"], w]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    assert [r.n_dropped for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == [0, 1, 1, 0, 0, 1, 1]


def test_short_lines(spark):
    docs = ["Home\nAll rights reserved.\nMenu one\na b c d\np q r s t u v", "Home\n  All   rights reserved.\nMenu two\na b x d\n\np q r s u v", "Contact\nall rights reserved.\nMenu one\na b c\nHome page"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup_lines(df).collect()}
    assert got == {0: (docs[0], 0), 1: ("Menu two\n", 4), 2: ("Contact\nHome page", 3)}


def test_lines_parameters_and_odd_rows(spark):
    texts = [(None, "one two three four"), (3, "one two three four\nx y"), (3, "one two three four\nx y"), (5, "x z\n\nlast one here"), (6, None), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in lines.dedup_lines(df).collect()), key=repr)
    want = [(None, "one two three four", 0), (3, "x y", 1), (3, "x y", 1), (5, "x z\n\nlast one here", 0), (6, None, 0), (None, None, 0)]
    assert got == sorted(want, key=repr)
    short = {r.doc_id: r.text for r in lines.dedup_lines(df.where("doc_id IN (3, 5)").distinct(), near_words=2).collect()}
    assert short == {3: "one two three four\nx y", 5: "\nlast one here"}
    assert {r.n_dropped for r in lines.dedup_lines(df, min_words=5).collect()} == {0}


def test_mixing(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else "small", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(df, {"big": 1.0, "small": 1.0}).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in out}
    assert None not in got and abs(got["big"] - 1500) < 150 and abs(got["small"] - 1500) < 150
    a, b = (sorted(mixing.mix_sources(df.repartition(n)).select("doc_id", "copy").collect()) for n in (2, 9))
    assert a == b
    assert mixing.mix_sources(df.limit(0)).count() == 0
    few, mixing.SMALL = mixing.SMALL, 1
    try:
        assert sorted(mixing.mix_sources(df).select("doc_id", "copy").collect()) == a
    finally:
        mixing.SMALL = few


def test_mixing_odd_rows(spark):
    """Clashing names stay; a rate of 4 repeats null ids, null and long texts and equal rows alike."""
    names = ["_source", "steps", "_steps", "_u", "_order", "Copies", "rate"]
    rows = [(i, "s", t, *(f"{n} {i}" for n in names)) for i, t in ((1, "a"), (2, None), (3, "long " * 40_000), (4, "same"), (4, "same"), (None, "x"), (None, "y"))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.mix_sources(df, epochs=4.0)
    assert out.columns == [c for c in df.columns if c != "Copies"] + ["copies", "copy"]
    got = out.collect()
    assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in names if n != "Copies") or any(r.doc_id is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.text].append(r.copy)
    assert sorted(by[4, "same"]) == sorted(list(range(1, max(by[4, "same"]) + 1)) * 2)
    assert sorted(by[None, "x"]) == sorted(by[None, "y"]) and all(min(c) == 1 for c in by.values())


def test_archive(spark, tmp_path):
    big, small = "x" * 1500, "y"
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "ü", "ü" * 700), (7, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write(df, path)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = {r.page_id: bytes(r.record) for r in warc.records(spark, path).collect()}
    for i, _, html in rows:
        head, body = records[i].split(b"\r\n\r\n", 1)
        want = b"" if i in (1, 2) else (html or "").encode()
        assert body == want + b"\r\n\r\n" and f"Content-Length: {len(want)}".encode() in head
    assert got[6].payload_bytes == 1400
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0 and warc.records(spark, str(tmp_path / "none")).count() == 0
    odd = spark.createDataFrame([(None, "u", big, "a"), (8, "u", big, "b"), (8, "u", big, "c"), (9, None, None, "d")], "page_id long, url string, html string, payload string")
    warc.write(odd, str(tmp_path / "odd"))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "odd")).collect()), key=repr)
    assert got == sorted([(None, "revisit", 8), (8, "response", None), (8, "response", None), (9, "response", None)], key=repr)
