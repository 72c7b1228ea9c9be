r"""Language-model scoring by prediction by partial matching.

The model sees a text as its lower-cased words joined by spaces and closed by an end symbol (byte 10, which no word
holds), and codes each byte from the five before it. A context's counts give a symbol (c - 1/2) / T, T being its count, and D / 2T,
D being its number of different symbols, to the escape to the next shorter context, in which symbols of the longer
one are excluded; below order 0 the remaining byte values share evenly. A text's score is the base-10
logarithm of its probability.

Pretrained: a byte's code length depends on its six-byte gram only, so it is computed once per distinct gram. Texts are
dealt into chunks of bounded bytes by a hash of their id. A chunk counts its distinct words and grams, which are never
capped, so the trie grows with the corpus, and hands them on packed, one row for each part of the trie that it touches. A
part adds up all chunks' counts: words fall to parts by a hash, grams by a hash of their last three context bytes, so that
a part has all that orders 3 to 5 need. It answers each row with the words' counts and the grams' code lengths, and a
chunk sums its answers over its texts. There are as many parts as chunks, so that neither grows with the corpus; rows
between them are never more than the chunks' distinct grams and words. Orders 0 to 2 are at most 256 ** 3 counts, of
which languages use few, and travel with the tasks.
Adaptive: each text is coded by a model that has seen only the text so far.

Nulls and extremes: a null text is empty and consists of the end token; ids may have any plain type; a null id counts
as training and stays null;
texts of any length are scored whole; repeated rows train as often as they occur and are all returned; without training
texts every symbol is equally likely; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b"\n"
ORDER = 5
FOLDS, HELD = 5, 1
CHUNK_BYTES = 12_000_000
#: Bytes of text, and rows of a batch, that are worked on together, and a bound on their texts: sixteen bits number them.
AT_ONCE, ROWS, TEXTS = 2_000_000, 200, 1 << 16
#: Distinct grams and distinct words that a task holds before it hands them on.
HOLD, WORDS = 1_500_000, 500_000
#: A-Z in lower case, white space as spaces.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text.translate(LOWER).split() if text else []) + [END]


def coded(words: list[bytes]) -> bytes:
    """The text that the model codes: words, single spaces, the end symbol."""
    return b" ".join(words[:-1]) + END


def slices_of(texts: pa.ChunkedArray) -> Iterator[list[bytes | None]]:
    """Texts, a bounded number of bytes (or one text) at once, without a second copy of all texts."""
    out: list = []
    size = 0
    for at in range(0, len(texts), ROWS):
        for t in texts.slice(at, ROWS).to_pylist():
            out.append(t)
            size += len(t or b"")
            if size > AT_ONCE or len(out) == TEXTS:
                yield out
                out, size = [], 0
    if out:
        yield out


def coded_bytes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """What the model codes of all texts, each after as many end symbols as a context has, and where each text ends."""
    plain = ((t or b"").translate(PLAIN).strip(b" ") for t in texts)
    raw = np.frombuffer(END * ORDER + (END * (ORDER + 1)).join(plain) + END, np.uint8)
    space = raw == 32
    again = space[1:] & space[:-1]
    if again.any():
        raw = raw[np.concatenate(([True], ~again))]
    return raw, np.flatnonzero(raw == END[0])[ORDER :: ORDER + 1]


def grams(raw: np.ndarray, ends: np.ndarray, number: bool = False) -> np.ndarray:
    """Six-byte grams of all positions of all texts in order of value; if asked, each with its text's number below."""
    #: Two bytes, then four, then six: most of the work is on short integers.
    two = raw.astype(np.uint16)
    two = two[:-1] << 8 | two[1:]
    four = two.astype(np.uint32)
    g = (four[:-2] << 16 | four[2:])[: len(raw) - ORDER].astype(np.uint64)
    g <<= 16
    g |= two[4:]
    if number:
        g <<= 16
        g |= np.repeat(np.arange(len(ends), dtype=np.uint16), np.diff(ends, prepend=ORDER - 1))
    #: Positions that predict padding don't count; they go last.
    for k in range(ORDER):
        g[ends[:-1] - k] = np.iinfo(np.uint64).max
    g.sort()
    return g[: len(g) - ORDER * (len(ends) - 1)]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ordered array and how often each occurs."""
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.diff(starts, append=len(ordered))


def words_in(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of coded bytes, each with a space behind it, and how many of them each text has."""
    gap = (raw == 32) | (raw == END[0])
    keep = np.concatenate(([False], ~(gap[1:] & gap[:-1])))
    return np.where(gap, np.uint8(32), raw)[keep], np.diff(np.cumsum(gap & keep)[ends], prepend=0)


def cut_at(values: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary of the values up to each end."""
    at = (np.concatenate(([0], ends)) * values.itemsize).astype(np.int64 if kind else np.int32)
    return pa.Array.from_buffers(kind or pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def split_words(spaced: np.ndarray) -> pa.Array:
    """The words of bytes in which each has a space behind it (which stays)."""
    return cut_at(spaced, np.flatnonzero(spaced == 32) + 1, pa.large_binary())


def unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and where each row's end."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows))) // np.dtype(kind).itemsize


def sums(code: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(code, counts, size).astype(np.int64)


def coded_keys(keys: np.ndarray | pa.Array) -> tuple[np.ndarray, np.ndarray | pa.Array]:
    """Every key's place among the distinct ones, and these."""
    if isinstance(keys, np.ndarray):
        return pd.factorize(keys)
    found = keys.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


class Tally:
    """Counts of integers or words in bounded memory: merged, and handed on when too many differ."""

    def __init__(self, hold: int = HOLD):
        self.keys, self.counts, self.held, self.hold = [], [], 0, hold

    def add(self, keys: np.ndarray | pa.Array, counts: np.ndarray) -> Iterator[tuple]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * self.hold:
            self.merge()
            if self.held > self.hold:
                yield from self.rest()

    def merge(self) -> None:
        join = np.concatenate if isinstance(self.keys[0], np.ndarray) else pa.concat_arrays
        code, distinct = coded_keys(join(self.keys))
        self.keys, self.counts, self.held = [distinct], [sums(code, np.concatenate(self.counts), len(distinct))], len(distinct)

    def rest(self) -> Iterator[tuple]:
        if self.keys:
            self.merge()
            yield self.keys[0], self.counts[0]
            self.keys, self.counts, self.held = [], [], 0


def part_of(hashed: np.ndarray, parts: int) -> np.ndarray:
    """The part that an integer falls to, whatever its low bits are."""
    return ((hashed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def word_rows(chunk: int, parts: int, words: pa.Array, counts: np.ndarray) -> pa.Table:
    part = part_of(pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False), parts)
    by = np.argsort(part, kind="stable")
    words, (own, number) = words.take(pa.array(by)), runs(part[by])
    ends, letters = np.cumsum(number), np.cumsum(pa.compute.binary_length(words).to_numpy())
    spaced = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    return pa.table({"chunk": np.full(len(own), chunk, np.int32), "part": own, "words": cut_at(spaced, letters[ends - 1]), "seen": cut_at(counts[by], ends)})


def gram_rows(chunk: int, parts: int, grams: np.ndarray, counts: np.ndarray) -> pa.Table:
    by = np.argsort(grams)
    grams, counts = grams[by].astype(np.int64), counts[by]
    part = part_of(grams >> 8 & 0xFFFFFF, parts)
    by = np.argsort(part, kind="stable")
    own, number = runs(part[by])
    ends, seen = np.cumsum(number), counts > 0
    code, key = pd.factorize(grams[seen] & 0xFFFFFF)
    low = pa.StructArray.from_arrays([pa.array(key), pa.array(sums(code, counts[seen], len(key)))], ["key", "n"])
    first = pa.array(np.where(np.arange(len(own) + 1) > 0, len(low), 0).astype(np.int32))
    return pa.table({
        "chunk": np.full(len(own), chunk, np.int32), "part": own, "grams": cut_at(grams[by], ends), "n": cut_at(counts[by], ends), "low": pa.ListArray.from_arrays(first, low),
    })


#: Of a chunk and a part: words with a space behind each, and their counts in training texts; in other rows grams and
#: theirs, all as packed longs. low: counts of a chunk's grams by last two context bytes and symbol, in one of its rows.
HOLDS = "chunk int, part int, words binary, seen binary, grams binary, n binary, low array<struct<key:bigint,n:bigint>>"
ANSWERS = "chunk int, words binary, seen binary, grams binary, value binary, train_words bigint, kinds bigint"


def counted(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Distinct words and grams of a chunk's texts as HOLDS; what only held-out texts have comes with 0."""
    longs = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("words", "seen", "grams", "n")), ("low", longs)])

    def run(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk")[0].as_py()
        words, found, out = Tally(WORDS), Tally(), []
        for held in (False, True):
            for texts in slices_of(rows.filter(pa.compute.equal(rows.column("held_out"), held)).column("text")):
                raw, ends = coded_bytes(texts)
                code, distinct = coded_keys(split_words(words_in(raw, ends)[0]))
                number = np.bincount(code, minlength=len(distinct))
                out += [word_rows(chunk, parts, *x) for x in words.add(distinct, 0 * number if held else number)]
                distinct, number = runs(grams(raw, ends))
                out += [gram_rows(chunk, parts, *x) for x in found.add(distinct, 0 * number if held else number)]
        out += [word_rows(chunk, parts, *x) for x in words.rest()] + [gram_rows(chunk, parts, *x) for x in found.rest()]
        pa.default_memory_pool().release_unused()
        return pa.concat_tables([pa.table([t[c] if c in t.column_names else pa.nulls(len(t), kind) for c, kind in zip(schema.names, schema.types, strict=True)], schema) for t in out])

    return run


def answered(low: tuple[np.ndarray, np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """A part's HOLDS of all chunks as ANSWERS: a word's count in all training texts, a gram's code length.
    In one row: the words of training texts, and how many differ."""
    lengths = code_lengths(low)

    def run(rows: pa.Table) -> pa.Table:
        has_words = rows.column("words").is_valid()
        words, found = rows.filter(has_words), rows.filter(pa.compute.invert(has_words))
        seen, word_ends = unpacked(words.column("seen"), np.int64)
        code, distinct = coded_keys(split_words(np.frombuffer(b"".join(words.column("words").to_pylist()), np.uint8)))
        number = sums(code, seen, len(distinct))
        n, ends = unpacked(found.column("n"), np.int64)
        which, own = pd.factorize(unpacked(found.column("grams"), np.int64)[0])
        value = lengths(own, sums(which, n, len(own)))
        once = np.arange(len(words) + len(found)) == 0
        none = [pa.nulls(len(t), pa.binary()) for t in (words, found)]
        return pa.table({
            "chunk": pa.chunked_array(words.column("chunk").chunks + found.column("chunk").chunks, pa.int32()),
            "words": pa.chunked_array([*words.column("words").chunks, none[1]]), "seen": pa.chunked_array([cut_at(number[code], word_ends), none[1]]),
            "grams": pa.chunked_array([none[0], *found.column("grams").chunks]), "value": pa.chunked_array([none[0], cut_at(value[which], ends)]),
            "train_words": np.where(once, number.sum(), 0), "kinds": np.where(once, (number > 0).sum(), 0),
        })

    return run


def code_lengths(low: tuple[np.ndarray, np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Base-10 logarithms of distinct grams' probabilities, given these and their counts, for whole groups of grams
    with the last three context bytes in common. low: counts by last two context bytes and symbol, as sorted keys and
    numbers."""
    keys, number = low
    add = np.bincount
    context, last, symbol = keys >> 8, keys >> 8 & 255, keys & 255
    pairs = add(keys & 65535, number, 65536).reshape(256, 256)
    order0, follows = pairs.sum(axis=0), pairs > 0
    #: Totals and numbers of symbols of orders 2, 1 and 0; of the last two, what the longer context hasn't excluded.
    t2, f2 = add(context, number, 65536), add(context, number > 0, 65536)
    t1, f1 = np.tile(pairs.sum(axis=1), 256) - add(context, pairs[last, symbol], 65536), np.tile(follows.sum(axis=1), 256) - f2
    t0, f0 = order0.sum() - np.where(follows, order0, 0).sum(axis=1), (order0 > 0).sum() - follows.sum(axis=1)

    def level(c: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a symbol and of the escape, of what the exclusion has left."""
        twice = np.where(total > 0, 2.0 * total, 1.0)
        return (2 * c - 1) / twice, np.where(total > 0, kinds / twice, 1.0)

    def run(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        sym, last2, seen = g & 255, g >> 8 & 65535, n > 0
        #: Contexts of five, four and three bytes; a gram's place among grams with four and three, and these grams' contexts.
        ctx5, all5 = pd.factorize(g >> 8)
        at4, g4 = pd.factorize(g & 0xFFFFFFFFFF)
        ctx4, all4 = pd.factorize(g4 >> 8)
        at3, g3 = pd.factorize(g4 & 0xFFFFFFFF)
        ctx3, all3 = pd.factorize(g3 >> 8)
        n4 = add(at4, n, len(g4))
        n3 = add(at3, n4, len(g3))
        n2 = pd.Series(number, keys).reindex(g3 & 0xFFFFFF, fill_value=0).to_numpy()
        t5, f5 = add(ctx5, n, len(all5)), add(ctx5, seen, len(all5))
        t4, f4 = add(ctx4, n4, len(all4)), add(ctx4, n4 > 0, len(all4))
        t3, f3 = add(ctx3, n3, len(all3)), add(ctx3, n3 > 0, len(all3))
        out4 = add(ctx5, np.where(seen, n4[at4], 0), len(all5))
        out3 = add(ctx4, np.where(n4 > 0, n3[at3], 0), len(all4))
        out2 = add(ctx3, np.where(n3 > 0, n2, 0), len(all3))
        to3, by4 = at3[at4], ctx4[at4]
        by3 = ctx3[to3]
        c4, c3, c2, c1, c0 = n4[at4], n3[to3], n2[to3], pairs[last2 & 255, sym], order0[sym]
        p5, e5 = level(n, t5[ctx5], f5[ctx5])
        p4, e4 = level(c4, t4[by4] - out4[ctx5], f4[by4] - f5[ctx5])
        p3, e3 = level(c3, t3[by3] - out3[by4], f3[by3] - f4[by4])
        p2, e2 = level(c2, t2[last2] - out2[by3], f2[last2] - f3[by3])
        p1, e1 = level(c1, t1[last2], f1[last2])
        p0, e0 = level(c0, t0[last2 & 255], f0[last2 & 255])
        p = e0 / max(256 - (order0 > 0).sum(), 1)
        for c, known, escape in ((c0, p0, e1), (c1, p1, e2), (c2, p2, e3), (c3, p3, e4), (c4, p4, e5)):
            p = escape * np.where(c > 0, known, p)
        return np.log10(np.where(seen, p5, p))

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row a text."""
    ws = Workspace(docs.sparkSession, "ppm")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    size, train = texts.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    chunks = max(1, math.ceil(size / chunk_bytes))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.xxhash64(F.substring("text", 1, 64))), F.lit(chunks)).cast("int"))
    dealt = texts.groupBy("chunk")

    holds = ws.cut(dealt.applyInArrow(counted(chunks), HOLDS))
    low = holds.select(F.inline("low")).groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    model = answered((low.column("key").to_numpy(), low.column("n").to_numpy()))
    #: Sorted grams and repeated values shrink to less than half of what Snappy leaves. They lie on disk until the end.
    found = ws.cut(holds.drop("low").groupBy("part").applyInArrow(model, ANSWERS), "zstd")
    ws.drop(holds)
    total, distinct = found.agg(F.coalesce(F.sum("train_words"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    #: Every text has an end token.
    total, distinct = total + train, distinct + (train > 0)

    def log_base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        has_words = found.column("words").is_valid()
        part = found.filter(has_words)
        words = split_words(np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint8))
        seen = np.append(unpacked(part.column("seen"), np.int64)[0], 0)
        part = found.filter(pa.compute.invert(has_words))
        gram, value = unpacked(part.column("grams"), np.uint64)[0], unpacked(part.column("value"), np.float64)[0]
        by = np.argsort(gram)
        gram, value = gram[by], value[by]
        del found, part, by
        pa.default_memory_pool().release_unused()
        spaced, n_words, model = [], [], []
        for lists in slices_of(texts.column("text")):
            raw, ends = coded_bytes(lists)
            each, number = words_in(raw, ends)
            spaced.append(each)
            n_words.append(number)
            numbered = grams(raw, ends, number=True)
            own, n = runs(numbered >> 16)
            model.append(np.bincount((numbered & 0xFFFF).astype(np.int64), np.repeat(value[np.searchsorted(gram, own)], n), len(ends)))
        n_words = np.concatenate(n_words)
        c = seen[pa.compute.index_in(split_words(np.concatenate(spaced)), words).fill_null(-1).to_numpy()]
        text = np.repeat(np.arange(len(n_words)), n_words)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": n_words + 1,
            "n_known": sums(text, c > 0, len(n_words)) + (train > 0), "train_tokens": np.full(texts.num_rows, total, np.int64),
            "base_score": np.bincount(text, log_base(c), len(n_words)) + log_base(train), "score": np.concatenate(model),
        })

    return dealt.cogroup(found.select("chunk", "words", "seen", "grams", "value").groupBy("chunk")).applyInArrow(scored, schema)


def adaptive_bits(text: bytes, order: int = ORDER) -> float:
    """Base-10 logarithm of a text's probability under a model that learns as it goes, with the same escapes."""
    seen: dict[bytes, Counter] = {}
    past, total = END * order, 0.0
    for s in text:
        excluded: set = set()
        for k in range(order, -1, -1):
            left = {x: c for x, c in seen.get(past[len(past) - k :], {}).items() if x not in excluded}
            if left:
                twice = 2 * sum(left.values())
                if s in left:
                    total += math.log10((2 * left[s] - 1) / twice)
                    break
                total += math.log10(len(left) / twice)
                excluded |= left.keys()
        else:
            total += math.log10(1 / (256 - len(excluded)))
        for k in range(order + 1):
            seen.setdefault(past[len(past) - k :], Counter())[s] += 1
        past = (past + bytes([s]))[-order:]
    return total


def score_adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each text by itself; no training, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [adaptive_bits(coded(tokens_of(t))) for lists in slices_of(batch.column(1)) for t in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
