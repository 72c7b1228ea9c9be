r"""Alignment of two tokenizers' tokens, document by document, and how often tokens meet over all documents.

Both tokenizers cut the same bytes: a space and the text. The ends of the tokens, summed up from their lengths, are two rising
lists; a merge of them finds the places where both end. These cut the tokens into groups, and the two tokens that end
at such a place are linked. Tasks put the tokens of many texts end to end, so one merge serves them all. Links of up to
`chunk_bytes` of text make a chunk, in which each id pair has a short number of its own: a document keeps its links as such
numbers, the chunk keeps the list of its pairs. Spark sums the pairs' counts over all chunks, takes the highest of each id on
either side, and joins both back to the chunks' lists; a chunk's documents then meet its list only.

A pair that a third of all links share is one row a chunk; the highest counts are one row an id of a vocabulary and are
broadcast (at most `Bytes.size` rows). A text must be encoded whole, so one text's tokens fit in a task.

Nulls and extremes: a text that is null or empty, or whose tokens' bytes differ from space and text (a U+2581, which the second
tokenizer takes for a space), has no tokens: zeros and an empty digest. Null ids stay; repeated rows each count;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: How byte-level vocabularies cut a text before they merge (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose links share a list of pairs; bytes of text, and rows of a batch, worked on at once.
CHUNK_BYTES, AT_ONCE, ROWS = 16_000_000, 1_000_000, 500


def byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Bytes:
    """A vocabulary as the bytes of its ids (None: no id of a text), and what makes an encoder from it in a task.

    encoder() gives a function from texts to a list of arrays of ids.
    """

    tokens: tuple[bytes | None, ...]
    encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]]

    @property
    def size(self) -> int:
        return len(self.tokens)


def byte_level(path: str) -> Bytes:
    """A byte-level vocabulary of the tokenizers library. Special tokens' strings are plain text.

    Where ids stand in the order of the merges, a faster library gives the same ids; texts that it refuses (very long runs of
    white space) go to the file's own.
    """
    raw = Path(path).read_text(encoding="utf-8")
    spec = json.loads(raw)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    special = {t["content"] for t in spec["added_tokens"]}
    by = byte_of()
    tokens: list[bytes | None] = [None] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for token, i in model["vocab"].items():
        if token not in special:
            tokens[i] = bytes(by[c] for c in token)
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    same = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and merged == sorted(merged) and not model.get("ignore_merges")
    ranks = {t: i for i, t in enumerate(tokens) if t is not None} if same else None

    def encoder() -> Callable[[list[str]], list[np.ndarray]]:
        own: list = []

        def slow(text: str) -> np.ndarray:
            if not own:
                from tokenizers import Tokenizer

                own.append(Tokenizer.from_str(raw))
                own[0].encode_special_tokens = True
            return np.array(own[0].encode(text, add_special_tokens=False).ids, np.int64)

        if ranks is None:
            return lambda texts: [slow(" " + t) for t in texts]
        import tiktoken

        fast = tiktoken.Encoding("byte_level", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})

        def one(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:
                return slow(text)

        return lambda texts: [one(" " + t) for t in texts]

    return Bytes(tuple(tokens), encoder)


def piece_level(path: str) -> Bytes:
    """A vocabulary of the sentencepiece library, which puts the space before the text itself."""
    from sentencepiece import SentencePieceProcessor

    proto = Path(path).read_bytes()
    sp = SentencePieceProcessor(model_proto=proto)

    def bytes_at(i: int) -> bytes | None:
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            return None
        piece = sp.id_to_piece(i)
        return bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()

    tokens = tuple(map(bytes_at, range(sp.get_piece_size())))

    def encoder() -> Callable[[list[str]], list[np.ndarray]]:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=proto)
        return lambda texts: [np.array(x, np.int64) for x in library.encode(texts, num_threads=1)]

    return Bytes(tokens, encoder)


def spelt(ids: np.ndarray, tokens: tuple[bytes | None, ...], want: bytes) -> bool:
    """Whether the ids' bytes, put end to end, are the wanted ones."""
    parts = [tokens[i] for i in ids.tolist()]
    return None not in parts and b"".join(parts) == want


def meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two strictly rising lists where they hold the same number: a merge, both lists being walked once in order."""
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    i = np.flatnonzero(b[at] == a) if len(b) else np.empty(0, np.int64)
    return i, at[i]


class Aligner:
    """Groups and links of lists of texts."""

    def __init__(self, first: Bytes, second: Bytes):
        self.first, self.second = first, second
        self.a, self.b = first.encoder(), second.encoder()
        self.length_a, self.length_b = (np.array([len(t or b"") for t in v.tokens], np.int64) for v in (first, second))
        #: What is written for a token: its id and a comma, or what ends its side of a group.
        self.written = [f"{i}{s}" for v, ends in ((first, ",|"), (second, ",;")) for s in ends for i in range(v.size)]

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """For each text the numbers of tokens and groups, the digest of the groups and the linked pairs (a << 32 | b)."""
        some = [i for i, t in enumerate(texts) if t]
        plain = [texts[i] for i in some]
        good, ids_a, ids_b = [], [], []
        if plain:
            for i, text, x, y in zip(some, plain, self.a(plain), self.b(plain), strict=True):
                want = b" " + text.encode()
                if spelt(x, self.first.tokens, want) and spelt(y, self.second.tokens, want):
                    good.append(i)
                    ids_a.append(x)
                    ids_b.append(y)
        out: list = [(0, 0, 0, "", np.empty(0, np.int64))] * len(texts)
        if not good:
            return out
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        to_a, to_b = np.cumsum(list(map(len, ids_a))), np.cumsum(list(map(len, ids_b)))
        #: The texts stand end to end, and all their ends are ends of both.
        i, j = meet(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        pairs = a[i] << 32 | b[j]
        group_a, group_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        b_before = np.concatenate(([0], j + 1))[group_a]
        seq = np.empty(len(a) + len(b), np.int64)
        code_a, code_b = a.copy(), b + 2 * self.first.size
        code_a[i] += self.first.size
        code_b[j] += self.second.size
        seq[np.arange(len(a)) + b_before] = code_a
        seq[np.arange(len(b)) + (i + 1)[group_b]] = code_b
        to_group = np.searchsorted(i, to_a - 1) + 1
        start_a = start_b = start_g = 0
        for k, (end_a, end_b, end_g) in enumerate(zip(to_a.tolist(), to_b.tolist(), to_group.tolist(), strict=True)):
            text = "".join(map(self.written.__getitem__, seq[start_a + start_b : end_a + end_b].tolist()))[:-1]
            out[good[k]] = (end_a - start_a, end_b - start_b, end_g - start_g, hashlib.sha256(text.encode()).hexdigest(), pairs[start_g:end_g])
            start_a, start_b, start_g = end_a, end_b, end_g
        return out


def links(docs: DataFrame, first: Bytes, second: Bytes, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of two kinds. Documents: chunk, doc_id, n_a, n_b, n_groups, groups_sha256 and links (numbers in the chunk's list).
    Pairs of a chunk: chunk, number, pair and n, the links of that pair in the chunk; their groups_sha256 is null."""
    kind = docs.schema[id_col].dataType
    schema = f"chunk bigint, doc_id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>, number int, pair bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second)
        chunk, size = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        rows: list = []

        def written() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(r[4]) for r in rows], np.int64)
            found, code, n = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True, return_counts=True)
            number = np.empty(len(found), np.int32)
            number[np.argsort(-n, kind="stable")] = np.arange(len(found), dtype=np.int32)
            code = number[code]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            key = pa.concat_arrays(ids)
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                some = pa.ListArray.from_arrays(pa.array((ends[at : at + len(part) + 1] - ends[at]).astype(np.int32)), pa.array(code[ends[at] : ends[at + len(part)]]))
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, chunk)), key.slice(at, m), *(pa.array([r[i] for r in part], pa.int64()) for i in range(3)), pa.array([r[3] for r in part], pa.string()), some, pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                    names=names,
                )
            for at in range(0, len(found), 100 * ROWS):
                m = len(found[at : at + 100 * ROWS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, chunk)), pa.nulls(m, key.type), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int32())), *(pa.array(x[at : at + m]) for x in (number, found, n))],
                    names=names,
                )

        names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "number", "pair", "n"]
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to, held = at, 0
                while to < batch.num_rows and to - at < ROWS and (to == at or held + lengths[to] <= AT_ONCE):
                    held += int(lengths[to])
                    to += 1
                rows += aligner.align(batch.column(1).slice(at, to - at).to_pylist())
                ids.append(batch.column(0).slice(at, to - at))
                size += held + 100 * (to - at)
                at = to
                if size > chunk_bytes:
                    yield from written()
                    rows, ids, size, chunk = [], [], 0, chunk + 1
        if rows:
            yield from written()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def align(docs: DataFrame, first: Bytes, second: Bytes, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, n_mutual, count_sum and groups_sha256, one row a document.

    n_best: links whose count is the highest of their second id; n_mutual: of both ids. count_sum: counts of all links.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ws = Workspace(docs.sparkSession, "align")
    made = ws.cut(links(docs, first, second, id_col, text_col, chunk_bytes))
    of_chunk = made.where("pair IS NOT NULL").select("chunk", "number", "pair", "n")
    counts = ws.cut(of_chunk.groupBy("pair").agg(F.sum("n").alias("total")).selectExpr("pair", "total", "shiftright(pair, 32) AS a", "pair & 4294967295 AS b"))
    most_a, most_b = (F.broadcast(counts.groupBy(x).agg(F.max("total").alias(f"most_{x}"))) for x in "ab")
    rated = counts.join(most_a, "a").join(most_b, "b").selectExpr("pair", "total", "total = most_b AS best", "total = most_b AND total = most_a AS mutual")
    lists = of_chunk.join(rated, "pair").select(F.col("chunk").alias("of_chunk"), "number", "total", "best", "mutual")
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, n_mutual bigint, count_sum bigint, groups_sha256 string"

    def summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(out_names, [docs.schema.field("doc_id").type, *7 * [pa.int64()], pa.string()], strict=True)})
        at = pairs.column("number").to_numpy()
        values = []
        for name in ("best", "mutual", "total"):
            value = np.zeros(len(at), np.int64)
            value[at] = pairs.column(name).to_numpy().astype(np.int64)
            values.append(value)
        column = docs.column("links").combine_chunks()
        code, ends = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(column).to_numpy())))
        sums = [np.concatenate(([0], np.cumsum(v[code]))) for v in values]
        n_best, n_mutual, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
        own = {n: docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups")}
        return pa.table({**own, "n_links": np.diff(ends), "n_best": n_best, "n_mutual": n_mutual, "count_sum": count_sum, "groups_sha256": docs.column("groups_sha256")})

    out_names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_mutual", "count_sum", "groups_sha256"]
    texts = made.where("groups_sha256 IS NOT NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return texts.groupBy("chunk").cogroup(lists.groupBy("of_chunk")).applyInArrow(summed, schema)
