"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts (a run of spaces with the characters after it, as no piece goes on after
that) are put end to end and a suffix array over them is built. Every piece is searched in it by halving, which gives
all its occurrences at once: the edges. They are relaxed in order of the pieces' scores and, within a piece, of
position: an edge over exactly two neighbouring symbols joins them. For a vocabulary learned by byte-pair merges that is
the library's result, unlike a best-path search over the same edges, which fits unigram vocabularies. A character
without a piece becomes its bytes' pieces. Pieces and scores are read once on the driver and travel with the task.

Nulls and extremes: a null or empty text has no pieces and decodes to an empty text. Texts of any length are encoded
whole. U+2581 decodes to a space, as in the library. Repeated rows are encoded alike; null ids stay; extra columns stay
if named; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct segments remembered by a task, and characters of new ones indexed at once.
REMEMBERED, AT_ONCE = 200_000, 750_000
#: Texts of a batch that are worked on at once.
ROWS = 1000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in order of their ids; ranks gives the ids of the pieces of two or more characters, best score first."""

    pieces: tuple[str, ...]
    ranks: tuple[int, ...]
    bytes_at: tuple[int, ...]
    dropped: frozenset

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = tuple(sp.id_to_piece(i) for i in range(n))
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        crossing = [pieces[i] for i in plain if re.search(f"[^{SPACE}]{SPACE}", pieces[i])]
        if crossing:
            raise ValueError(f"pieces that go on after a space aren't supported: {crossing[:3]}")
        if any(sp.get_score(i) != int(sp.get_score(i)) for i in plain):
            raise ValueError("only vocabularies learned by merges are supported: scores of others are probabilities, not an order")
        by = {pieces[i]: i for i in range(n) if sp.is_byte(i)}
        at = tuple(by[f"<0x{b:02X}>"] for b in range(256))
        return cls(pieces, tuple(sorted((i for i in plain if len(pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))), at, frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of what follows them, compared over at least `depth` characters, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    size, n = 1, len(codes)
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(n - size, 0)] = rank[size:] + 1
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        size *= 2
        if size >= depth:
            return order
        ranked = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))


def occurrences(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted string (a row of codes, padded) the range of the suffix array that starts with it."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    padded = np.concatenate((codes, np.zeros(wanted.shape[1], codes.dtype)))

    def bound(d: int, who: np.ndarray, right: bool) -> np.ndarray:
        a, b, c = lo[who].copy(), hi[who].copy(), wanted[who, d]
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = padded[order[np.minimum(mid, len(order) - 1)] + d]
            up = open_ & ((at <= c) if right else (at < c))
            a, b = np.where(up, mid + 1, a), np.where(open_ & ~up, mid, b)
        return a

    for d in range(wanted.shape[1]):
        who = np.flatnonzero((lengths > d) & (lo < hi))
        first, last = bound(d, who, False), bound(d, who, True)
        lo[who], hi[who] = first, last
    return lo, hi


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        ranked = [vocabulary.pieces[i] for i in vocabulary.ranks]
        self.lengths = np.array([len(p) for p in ranked])
        self.wanted = np.zeros((len(ranked), int(self.lengths.max())), np.uint32)
        for row, p in zip(self.wanted, ranked, strict=True):
            row[: len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.dropped}
        self.known: dict[str, np.ndarray] = {}

    def learn(self, segments: list[str]) -> None:
        """Encode new distinct segments together."""
        text = "\0".join(segments) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        order = suffix_array(codes, self.wanted.shape[1])
        lo, hi = occurrences(codes, order, self.wanted, self.lengths)
        n = len(codes)
        end = np.arange(1, n + 2)  # of the symbol that starts at a position
        head = np.ones(n + 1, bool)
        for r in np.flatnonzero(hi > lo):
            size = int(self.lengths[r])
            start = np.sort(order[lo[r] : hi[r]])
            start = start[head[start]]
            middle = end[start]
            good = (middle < start + size) & head[np.minimum(middle, n)] & (end[np.minimum(middle, n)] == start + size)
            start, middle = start[good], middle[good]
            if len(start) > 1 and (start[1:] - start[:-1] < size).any():
                free, keep = -1, []
                for i, s in enumerate(start.tolist()):
                    if s >= free:
                        keep.append(i)
                        free = s + size
                start, middle = start[keep], middle[keep]
            end[start] = start + size
            head[middle] = False
        heads = np.flatnonzero(head[:n])
        at = heads.tolist()
        stops = [*at[1:], n]
        out: list[int] = []
        done = iter(segments)
        for a, b in zip(at, stops, strict=True):
            symbol = text[a:b]
            if symbol == "\0":
                self.known[next(done)] = np.array(out, np.int32)
                out = []
            elif symbol in self.ids:
                out.append(self.ids[symbol])
            else:
                out.extend(self.v.bytes_at[x] for x in symbol.encode("utf-8", "surrogatepass"))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offsets of each text's."""
        parts = [SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new: list[str] = []
        size = 0
        for s in dict.fromkeys(s for p in parts for s in p):
            if s not in self.known:
                if "\0" in s:
                    self.apart(s)
                    continue
                new.append(s)
                size += len(s) + 1
                if size > AT_ONCE:
                    self.learn(new)
                    new, size = [], 0
        if new:
            self.learn(new)
        ids = [self.known[s] for p in parts for s in p]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return np.concatenate(ids) if ids else np.empty(0, np.int32), ends[np.cumsum([0, *map(len, parts)])]

    def apart(self, segment: str) -> None:
        """A segment with the separator in it: no piece holds that, so what stands between is encoded by itself."""
        pieces = segment.split("\0")
        for p in dict.fromkeys(p for p in pieces if p and p not in self.known):
            self.learn([p])
        zero = np.array([self.v.bytes_at[0]], np.int32)
        parts = [x for p in pieces for x in (zero, self.known[p] if p else zero[:0])][1:]
        self.known[segment] = np.concatenate(parts)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.byte = {i: b for b, i in enumerate(vocabulary.bytes_at)}
        self.pieces = ["" if i in vocabulary.dropped else p.replace(SPACE, " ") for i, p in enumerate(vocabulary.pieces)]
        self.raw = [bytes([self.byte[i]]) if i in self.byte else p.encode() for i, p in enumerate(self.pieces)]

    def decode(self, ids: list[int]) -> str:
        whole = b"".join(map(self.raw.__getitem__, ids))
        return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The id columns, ids (array of int), n_tokens and whether decoding gives the text back."""
    fields = [docs.schema[c] for c in id_cols]
    picked = docs.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>", "n_tokens bigint", "restored boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids, offsets = encoder.encode(texts)
                same = [decoder.decode(ids[a:b].tolist()) == (t or "").replace(SPACE, " ") for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), lists, pa.array(np.diff(offsets)), pa.array(same)], names=[*(f.name for f in fields), "ids", "n_tokens", "restored"])

    return picked.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns and the text of the pieces; null ids give an empty text."""
    fields = [encoded.schema[c] for c in id_cols]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            texts = [decoder.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(texts, pa.string())], names=[*(f.name for f in fields), "text"])

    return encoded.select(*id_cols, ids_col).mapInArrow(run, schema)
