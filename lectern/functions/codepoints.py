"""Whole-batch text kernels: an Arrow string column is taken as one array of code points.

No Python object is made per text, word or character. Tables indexed by code point give each
character's class and folded form; boundaries, counts and word hashes come from cumulative sums.
Batches are worked off in passes of some hundred thousand characters, so that the arrays stay in cache.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Code points from here on share the last table entry, a letter.
TOP = 0x20000
PASS_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15
#: Characters removed from a canonical text besides punctuation and space: ASCII signs that Unicode calls symbols.
_SIGNS = "$+<=>^`|~"


@cache
def tables() -> dict[str, np.ndarray]:
    """word: letters and digits; space: white space; loose: white space, punctuation and ASCII signs; upper: capital letters; lower: the folded code point; long: characters that fold to several."""
    n = TOP
    word, space, loose, upper, long = (np.zeros(n, bool) for _ in range(5))
    lower = np.arange(n, dtype=np.uint32)
    for i in range(n):
        ch = chr(i)
        kind = unicodedata.category(ch)
        word[i] = ch.isalnum()
        space[i] = ch.isspace()
        loose[i] = space[i] or kind[0] == "P" or ch in _SIGNS
        upper[i] = kind == "Lu"
        if kind[0] == "L" or kind in ("Nl", "So"):
            folded = ch.upper().lower() if len(ch.upper()) == 1 else ch.lower()
            if len(folded) == 1:
                lower[i] = ord(folded)
            long[i] = len(ch.upper()) > 1
    word[n - 1] = True
    return {"word": word, "space": space, "loose": loose, "upper": upper, "lower": lower, "long": long}


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        powers, inverse = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        _powers, _inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Pass:
    """Texts ``i`` to ``j`` of a batch: their code points end to end, and where each text starts (one entry more than texts). A null text is empty."""

    i: int
    j: int
    code: np.ndarray
    off: np.ndarray

    def __post_init__(self) -> None:
        self.at = np.minimum(self.code, TOP - 1)


def passes(column: pa.Array) -> Iterator[Pass]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + PASS_BYTES, "right")) - 1))
        part = buf[offsets[i] : offsets[j]]
        off = offsets[i : j + 1] - offsets[i]
        code = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
        if len(code) != len(part):
            begins = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            if begins[-1] == len(code):
                off = begins[off]
            else:  # not valid UTF-8: each text on its own
                each = [np.frombuffer(part[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4") for a, b in zip(off[:-1], off[1:])]
                code, off = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        yield Pass(i, j, code, off)
        i = j


def edges(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of characters for which ``member`` holds; runs end where texts end."""
    if not len(member):
        z = np.zeros(0, np.int64)
        return z, z
    before = np.empty(len(member), bool)
    before[0] = False
    before[1:] = member[:-1]
    inner = off[(off > 0) & (off < len(member))]
    before[inner] = False
    starts = np.flatnonzero(member & ~before)
    after = np.empty(len(member), bool)
    after[-1] = False
    after[:-1] = member[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(member & ~after) + 1


def words(p: Pass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (run of letters or digits), and the first word of each text (one entry more than texts)."""
    start, end = edges(tables()["word"][p.at], p.off)
    return start, end, np.searchsorted(start, p.off)


def space_counts(p: Pass) -> np.ndarray:
    """Words of each text as parted by white space."""
    start, _ = edges(~tables()["space"][p.at], p.off)
    return np.diff(np.searchsorted(start, p.off))


def word_hashes(p: Pass, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word in folded case."""
    if not len(start):
        return np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(p.code) + 1)
    cum = np.zeros(len(p.code) + 1, np.uint64)
    np.cumsum(tables()["lower"][p.at] * powers[: len(p.code)], out=cum[1:])
    return mix((cum[end] - cum[start]) * inverse[start] + (end - start).astype(np.uint64))


def hash_word(word: str) -> int:
    """The hash that ``word_hashes`` gives a single word."""
    p = next(passes(pa.array([word])))
    return int(word_hashes(p, np.array([0]), np.array([len(p.code)]))[0])


def runs(hashed: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` consecutive words that stay within one text, and the first run of each text (one entry more than texts)."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    bound = np.concatenate([[0], np.cumsum(count)])
    if not bound[-1]:
        return np.zeros(0, np.uint64), bound
    at = np.arange(bound[-1]) + np.repeat(first[:-1] - bound[:-1], count)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashed[at + i]
    return mix(out), bound


def to_strings(code: np.ndarray, off: np.ndarray) -> pa.Array:
    """Code points and text bounds back to a string column."""
    size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(size)])[off].astype(np.int32)
    data = np.ascontiguousarray(code, "<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data))


def canonical(p: Pass) -> pa.Array:
    """The texts without white space, punctuation and case."""
    t = tables()
    if t["long"][p.at].any():  # rare letters whose capital is longer
        texts = [np.ascontiguousarray(p.code[a:b]).tobytes().decode("utf-32-le", "replace").upper().lower() for a, b in zip(p.off[:-1], p.off[1:])]
        off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        q = Pass(p.i, p.j, np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4"), off)
        keep = ~t["loose"][q.at]
        return to_strings(q.code[keep], np.concatenate([[0], np.cumsum(keep)])[off])
    keep = ~t["loose"][p.at]
    folded = np.where(p.code < TOP, t["lower"][p.at], p.code)[keep]
    return to_strings(folded, np.concatenate([[0], np.cumsum(keep)])[p.off])
