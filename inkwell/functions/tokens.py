"""Words and counts of many texts at once, on the bytes of Arrow's strings; for use inside tasks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, MARK, SPACE, GLYPH = 1, 2, 4, 8, 16
#: Bytes of text that are worked on together; a longer text comes alone.
AT_ONCE = 1_000_000
#: List glyphs as quality.GLYPHS has them.
GLYPHS = (0x2022, 0x2023, 0x25AA, 0x25CF, 0x25E6, 0x2043, 0x2219, 0xB7, 0x2713, 0x2714, 0x2717, 0x2718, 0x2610, 0x2611, 0x2612, *range(0x2700, 0x27C0), *range(0xE000, 0xF900))


def kind_of(point: int) -> int:
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(point))[0], 0)


@cache
def plane() -> np.ndarray:
    """Kinds of the first 65536 characters. Spaces are those of Java's \\s but line breaks."""
    out = np.array([kind_of(i) for i in range(1 << 16)], np.uint8)
    out[[ord(c) for c in "'-"]] = MARK
    out[[ord(c) for c in " \t\x0b\f"]] = SPACE
    out[list(GLYPHS)] |= GLYPH
    return out


def kinds_of(points: np.ndarray) -> np.ndarray:
    table = plane()
    far = points >= len(table)
    if not far.any():
        return table[points]
    out = table[np.where(far, 0, points)]
    some, at = np.unique(points[far], return_inverse=True)
    out[far] = np.array([kind_of(int(i)) for i in some], np.uint8)[at]
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and where each begins, with the end of the last; a null has none."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    begins = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[begins[0] : begins[-1]], begins - begins[0]


def parts(sizes: np.ndarray, at_once: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `at_once` bytes together, or of one row."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + at_once, side="right")) - 1)
        yield at, end
        at = end


class Words:
    """The maximal runs of characters of some kinds in lower-cased texts, none across texts.

    row: the text of each; begin, end: its characters; code: a number, equal for equal words; names: the words by number.
    """

    def __init__(self, texts: pa.Array, inside: int, but: int = 0):
        lower = pc.utf8_lower(texts)
        data, begins = bytes_of(lower)
        self.data, points = data, data
        if len(data) and data.max() > 127:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            self.at = np.append(lead, len(data))
            first = np.searchsorted(lead, begins)
        else:
            self.at, first = np.arange(len(data) + 1), begins
        self.kinds = kinds_of(points)
        hit = (self.kinds & inside) > 0
        if but:
            hit &= (self.kinds & but) == 0
        #: Texts that aren't empty begin and end runs.
        edge = first[:-1][first[1:] > first[:-1]]
        opens, closes = hit.copy(), hit.copy()
        opens[1:] &= ~hit[:-1]
        closes[:-1] &= ~hit[1:]
        opens[edge] = hit[edge]
        closes[edge[1:] - 1] = hit[edge[1:] - 1]
        self.begin, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.begin, first)))
        cuts = np.empty(2 * len(self.begin), np.int32)
        cuts[::2], cuts[1::2] = self.at[self.begin], self.at[self.end]
        n = max(0, len(cuts) - 1)
        between = pa.StringArray.from_buffers(n, pa.py_buffer(cuts if n else np.zeros(1, np.int32)), pa.py_buffer(data))
        coded = between.take(pa.array(np.arange(0, n, 2))).dictionary_encode()
        self.code, self.names = coded.indices.to_numpy(), coded.dictionary

    def among(self, words: list[str]) -> np.ndarray:
        """Which words are among some."""
        return pc.is_in(self.names, pa.array(words, pa.string())).to_numpy(zero_copy_only=False)[self.code]

    def between(self, begin: int, end: int) -> str:
        """The text from one character to another."""
        return self.data[self.at[begin] : self.at[end]].tobytes().decode()


def table_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD, VOWEL, END, BREAK = table_of(UPPER + UPPER.lower() + "'-"), table_of("aeiouyAEIOUY"), table_of(".!?"), table_of("\n\r\x0b\f")
#: A hyphen at a text's end, or before its last line break.
TAIL = re.compile(rb"(?<!-)-++(?=(?:\r\n|[\n\r]|\xc2\x85|\xe2\x80[\xa8\xa9])?\Z)")


def runs(hit: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many runs of hits each text has."""
    opens = hit.copy()
    opens[1:] &= ~hit[:-1]
    edge = begins[:-1][begins[1:] > begins[:-1]]
    opens[edge] = hit[edge]
    return np.diff(np.searchsorted(np.flatnonzero(opens), begins))


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_count, sentence_count and syllable_count (functions.text) of each text; a null is empty."""
    data, begins = bytes_of(texts)
    if not len(data):
        return np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64), np.ones(len(texts), np.int64)
    full = begins[1:] > begins[:-1]
    first, last = data[np.minimum(begins[:-1], len(data) - 1)], data[np.maximum(begins[1:] - 1, 0)]
    words = runs(WORD[data], begins)
    #: Apostrophes and hyphens at the ends may be runs of their own, which don't count.
    odd = full & ((first == 39) | (first == 45) | (last == 45) | BREAK[last] | (last > 127))
    for i in np.flatnonzero(odd):
        text = data[begins[i] : begins[i + 1]].tobytes()
        if text[0] in b"'-" or b"-" in text[-4:]:
            words[i] = len(re.findall(rb"[A-Za-z'-]+", TAIL.sub(b"", text.lstrip(b"'-"))))
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    nxt, over = padded[1:-1], padded[2:]
    before = np.concatenate((np.zeros(1, np.uint8), data[:-1]))
    before[begins[:-1][full]] = 0
    breaks = BREAK[data] & ~((data == 10) & (before == 13))
    high = data.max() > 127
    if high:
        breaks |= (data == 0xC2) & (nxt == 0x85) | (data == 0xE2) & (nxt == 0x80) & ((over == 0xA8) | (over == 0xA9))
    #: A line break is an end mark and a space.
    marks = (END[data] | breaks) & ~END[before]
    ends = np.diff(np.searchsorted(np.flatnonzero(marks), begins))
    solid = np.flatnonzero(~table_of(" \t\0")[data])
    at = np.searchsorted(solid, begins[1:]) - 1
    tail = np.where(at >= 0, solid[np.maximum(at, 0)], 0) if len(solid) else np.zeros(len(texts), np.int64)
    held = (at >= 0) & (tail >= begins[:-1])
    closed = END[data[tail]] | BREAK[data[tail]]
    if high:
        two, three = data[np.maximum(tail - 1, 0)], data[np.maximum(tail - 2, 0)]
        closed |= (data[tail] == 0x85) & (two == 0xC2) | ((data[tail] == 0xA8) | (data[tail] == 0xA9)) & (two == 0x80) & (three == 0xE2)
    vowels = VOWEL[data]
    if high:
        #: This capital (U+0130) is an i with a dot over it, which isn't a vowel.
        vowels |= (data == 0xC4) & (nxt == 0xB0)
    return words, np.maximum(1, ends + ~(held & closed)), np.maximum(1, runs(vowels, begins))
