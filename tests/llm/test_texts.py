"""Collocations, token alignment and page text against brute force, with odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkwell.llm import align, collocations, pagetext

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_of(rows, depth=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        long = [p for p, a in counts.items() if a >= least and len(p) > 1]
        around = Counter()
        for p in long:
            for inner in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                around[inner] = max(around[inner], counts[p])
        found = []
        for p in long:
            a = counts[p]
            if not around[p] or 100 * around[p] < share * a:
                score, k = min((1_000_000 * a * a // (counts[p[:i]] * counts[p[i:]]), i) for i in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(df, **given):
    return sorted(tuple(r) for r in collocations.mine(df, **given).collect())


def sentences():
    rng = random.Random(11)
    odd = [(None, "en"), ("", None), ("a b\ta  b. A B", "und"), ("x\x1cy z q é É x y", None), ("a b " * 3000, "xx"), ("long", "yy")]
    odd += [(" ".join(rng.choice(["A", "b", "c", "d.", "e", "É", "Straße,"]) for _ in range(rng.randint(1, 300))), rng.choice(["en", None])) for _ in range(30)]
    return odd + odd[-3:]


@pytest.mark.parametrize("shard", [700, 10_000_000])
def test_collocations(spark, shard):
    rows = sentences()
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(3)
    for depth in (2, 3, 4):
        want = phrases_of(rows, depth)
        assert want and mined(df, most_words=depth, shard=shard) == want
    assert mined(df, top=4, least=3, share=80, shard=shard) == phrases_of(rows, top=4, least=3, share=80)
    assert mined(df.limit(0)) == []


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000
    df = spark.createDataFrame([(a, a, a + 1)], "a bigint, l bigint, r bigint")
    d = "CAST({} AS DECIMAL(14, 0))".format
    got = df.selectExpr(f"({d('a')} * {d('a')} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({d('l')} * {d('r')}) AS s").first().s
    assert got == 1_000_000 * a * a // (a * (a + 1))


def test_automaton():
    made = collocations.Automaton([b"a b a b c. a b", b"b c"], 3)
    words = [w.decode() for w in made.words.to_pylist()]
    assert made.total == 9 and dict(zip(words, made.count[0].tolist(), strict=True)) == {"a": 3, "b": 4, "c": 2}
    for level, want in ((1, {"a b": 3, "b a": 1, "b c": 2}), (2, {"a b a": 1, "b a b": 1, "a b c": 1})):
        states = np.arange(len(made.count[level]))
        names = [p.decode() for p in made.phrases(level, states).to_pylist()]
        assert dict(zip(names, made.count[level].tolist(), strict=True)) == want
        below = [p.decode() for p in made.phrases(level - 1, np.arange(len(made.count[level - 1]))).to_pylist()]
        assert [below[i] for i in made.link[level]] == [p.split(" ", 1)[1] for p in names]
        assert [below[i] for i in made.source[level]] == [p.rsplit(" ", 1)[0] for p in names]


def test_bits_of_phrases_agree(spark):
    made = collocations.Automaton(["naïve cat sat".encode()], 2)
    at = made.buckets(1, "fr", 1 << 13)
    names = [p.decode() for p in made.phrases(1, np.arange(2)).to_pylist()]
    df = spark.createDataFrame([("fr", p) for p in names], "lang string, phrase string")
    assert [r.at for r in df.selectExpr(f"{collocations.bucket('lang', 'phrase', 1 << 13)} AS at").collect()] == at.tolist()


tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def aligned_by_hand(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    by, names = align.byte_of(), {i: t for t, i in first.get_vocab().items()}

    def of_piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    done, counts = [], Counter()
    for i, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        x, y = [bytes(by[c] for c in names[t]) for t in a], [of_piece(t) for t in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            done.append((i, 0, 0, [], []))
            continue
        n = m = at_a = at_b = 0
        groups, links, left, right = [], [], [], []
        while n < len(a) or m < len(b):
            if at_a <= at_b:
                at_a += len(x[n])
                left.append(a[n])
                n += 1
            else:
                at_b += len(y[m])
                right.append(b[m])
                m += 1
            if at_a == at_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                links.append((left[-1], right[-1]))
                left, right = [], []
        counts.update(links)
        done.append((i, len(a), len(b), groups, links))
    most_a, most_b = Counter(), Counter()
    for (p, q), c in counts.items():
        most_a[p], most_b[q] = max(most_a[p], c), max(most_b[q], c)
    best = lambda p: counts[p] == most_b[p[1]]
    return sorted((i, n, m, len(g), len(k), sum(map(best, k)), sum(best(p) and counts[p] == most_a[p[0]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n, m, g, k in done)


@pytest.mark.parametrize("chunk", [2_000, 16_000_000])
def test_alignment(spark, chunk):
    rng = random.Random(12)
    texts = [None, "", "▁x", " ", "  two  spaces ", "\n\n\t x", "日本語 テスト 🎉", "</s> <s> <|endoftext|>", "a\0b", "naïve", "same text", "same text", "word " * 30_000]
    texts += ["".join(rng.choices(["the ", "ing", "un", "é", "x", " ", "12", ".\n", "Über"], k=rng.randint(1, 300))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "no id")]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id bigint, text string, n_a int, links string").repartition(3)
    first, second = align.byte_level(A), align.piece_level(B)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in align.align(df, first, second, chunk_bytes=chunk).collect()), key=key)
    want = aligned_by_hand([(10**6 if i is None else i, t) for i, t in rows])
    assert [(10**6 if r[0] is None else r[0], *r[1:]) for r in got] == want
    assert align.align(df.limit(0), first, second).count() == 0


def test_a_long_run_of_spaces():
    text = " " * 1_000_000 + "x"
    ids = align.byte_level(A).encoder()([text])[0]
    assert align.spelt(ids, align.byte_level(A).tokens, (" " + text).encode())


def test_meet():
    assert [x.tolist() for x in align.meet(np.array([1, 3, 4, 9]), np.array([2, 3, 9]))] == [[1, 3], [1, 2]]
    assert [x.tolist() for x in align.meet(np.array([1]), np.array([], int))] == [[], []]


STORY = "<h2>Title of story</h2><p>First paragraph, with words &amp; commas, and more words in it. And another&nbsp;sentence   here.</p><p>Short.</p><ul><li>item one</li><li>item two</li></ul><p>Second <b>paragraph</b> has a <a href=x>link</a> and goes on,<br>on and on. It ends."
TEXT = "Title of story\nFirst paragraph, with words & commas, and more words in it. And another sentence here.\nShort.\nitem one\nitem two\nSecond paragraph has a link and goes on, on and on. It ends."


@pytest.mark.parametrize("page", [
    f'<html><body class="has-sidebar"><div id="page"><div class="topbar"><a href=/>Home</a></div><div id="cookieBar">We use cookies. Accept all of them, please.</div><div class="wrap"><div class="content">{STORY}</div>'
    '<div class="col2"><h3>Latest</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div></div><div id="c"><h3>3 Comments</h3><p>I think this is great, really great, as it says. Yes, it is.</p></div>'
    '<form><p>Subscribe. Now, today.</p></form><div class="foot">Imprint</div></div></body></html>',
    f"<body><header><h1>The Site</h1></header><nav><ul><li>Start</ul></nav><main>{STORY}</main><aside>See also, among others: this.</aside><footer>&copy; us, them. All rights reserved.</footer>",
    f'<article>{STORY}<section class="reader-comments"><article><p>A remark, long and full of marks; truly. It is one. It is.</p></article></section></article><div>A notice that is long, has marks, and stands outside. It goes on, and on.</div>',
    f'<form><div class="post-menu main"><h1 hidden>no</h1></div><!-- <p>not this</p> --><script>var a = "</p><p>nor, this.";</script><style>p {{}}</style><noscript>Turn it on.</noscript><article>{STORY}<aside>Advert. Buy, buy.</aside></article></form>',
    f'<div class="ad">Buy this now, today. It is good, cheap and new. It is.</div><div class="x">{STORY}</div><div role="alert">Look out, look out. Do. Do it, do it.</div><table class="menu"><tr><td>a, b.<td>c, d.</table>',
])
def test_page_text(page):
    assert pagetext.main_text(page) == TEXT


def test_page_text_of_odd_pages(spark):
    rows = [
        (1, "u", None, ""), (2, None, "", ""), (3, "u", "<nav>a</nav>", ""), (4, "u", "a < b & c &am", "a < b & c &am"), (None, "u", "<p>plain <b>text</b> only</p>more &lt;b&gt;", "plain text only\nmore <b>"),
        (5, "u", "<p>one<p>two", "one\ntwo"), (5, "u", "<p>one<p>two", "one\ntwo"), (6, "u", "<article><p>" + "word, word. " * 100_000, ("word, word. " * 100_000).strip()), (7, "u", "<p>x</p><p a='", "x"),
        (8, "u", "<article><h1>Only a heading</h1></article><div>outside it, there is. More, more.</div>", "Only a heading"),
    ]
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h, _ in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in pagetext.extract(df).collect())
    assert got == Counter((i, u, t, len(t)) for i, u, _, t in rows)
    assert pagetext.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<div>", "<p><b>", "</div>", "<li>", "<", "<a ", "&", "<!--", "<p a='", "<script>", "</", "<p a=\"<\"' >"])
def test_broken_markup_takes_time_in_proportion(part):
    assert len(pagetext.main_text(part * 30_000 + "x")) <= 60_001
