"""Held-out evaluation passages inside training documents.

Method: a generalised suffix automaton of the items' normalised words; each document's words are streamed
through it and the longest matching length at every word is tracked. Wherever it reaches ``seed`` words, the
places of those words name items and offsets; along that offset the passage is compared word by word, and a
stretch of at least ``least`` words in which no more than ``replaced`` of the words differ is a leak. Such a
stretch of 20 words with two replaced holds at least 16 - 2 * 5 = 6 matches of five words at one offset; offsets
with fewer, as phrases common to many items make, are not compared. Leaked stretches are the spans that are
removed; a document of which more than a limit would go is removed whole.

A word is a run of letters or digits; before that, characters that show nothing are dropped and letters lose
case, accents and styles, on both sides.

A document without any of the items' runs of ``seed`` words cannot reach that matching length; such
documents are told by hash before the automaton is run. Items are taken in blocks of ``BLOCK_WORDS`` words,
each broadcast once; a task holds the automata of one block, however many items there are. The passages,
as hashes of their words, pass through the driver: held-out items are a small set by nature.

Defined results: null or empty texts and passages match nothing; equal passages of several items are each
reported; a document with several leaks of one item is one row; repeated ids count once; empty tables give
empty tables; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import codepoints as cp
from lectern.plans.stage import written

BLOCK_WORDS = 400_000
#: Offsets this far apart count as one: a word that is split in two moves what follows.
DRIFT = 2


class SuffixAutomaton:
    """Of several sequences of word numbers. ``ends`` of a state: where its longest string ends, as (sequence, position)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[list[tuple[int, int]]] = [[]]
        for s, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.own[last].append((s, at))
        self.children: list[list[int]] = [[] for _ in self.link]
        for state, up in enumerate(self.link):
            if up >= 0:
                self.children[up].append(state)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def ends(self, state: int) -> Iterator[tuple[int, int]]:
        stack = [state]
        while stack:
            s = stack.pop()
            yield from self.own[s]
            stack.extend(self.children[s])

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int]]:
        """(end, state) wherever the longest match has at least ``least`` words; the state stands for its last ``least`` words, so its ends are all places where those occur."""
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                length = 0
            if length >= least:
                s = state
                while self.length[self.link[s]] >= least:
                    s = self.link[s]
                yield i, s


@cache
def _plain_table() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it shows nothing of its own (format characters and combining marks), and its base letter."""
    hidden, base = np.zeros(cp.TOP, bool), np.arange(cp.TOP, dtype=np.uint32)
    for i in range(cp.TOP):
        ch = chr(i)
        hidden[i] = unicodedata.category(ch) in ("Cf", "Mn", "Me")
        if i > 0x7F and not hidden[i] and not 0xAC00 <= i < 0xD7A4:
            bare = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)]
            if len(bare) == 1 and ord(bare[0]) < cp.TOP:
                base[i] = ord(bare[0])
    return hidden, base


def plain(p: cp.Pass) -> tuple[cp.Pass, np.ndarray]:
    """The texts without hidden characters and accents, and the place of each kept character in the pass."""
    hidden, base = _plain_table()
    kept = np.flatnonzero(~hidden[p.at])
    code = np.where(p.code[kept] < cp.TOP, base[p.at[kept]], p.code[kept]).astype(np.uint32)
    return cp.Pass(p.i, p.j, code, np.searchsorted(kept, p.off)), kept


class Items:
    """A block of passages as word hashes, with its vocabulary, runs and automaton."""

    def __init__(self, ids: list[int], passages: list[np.ndarray], seed: int):
        self.ids, self.passages = ids, passages
        self.vocabulary = np.unique(np.concatenate(passages)) if passages else np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum([len(x) for x in passages])])
        self.runs = np.unique(cp.runs(np.concatenate(passages), first, seed)[0]) if passages else np.zeros(0, np.uint64)
        self.automaton = SuffixAutomaton([self.numbers(x) for x in passages])

    def numbers(self, hashed: np.ndarray) -> list[int]:
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == hashed, at, -1).tolist() if len(self.vocabulary) else [-1] * len(hashed)

    def leaks(self, hashed: np.ndarray, seed: int, least: int, replaced: float) -> list[tuple[int, int, int, float]]:
        """(item, first word, last word + 1, share of the passage) of the longest leaked stretch of each item of which
        the document holds enough."""
        hits: Counter[tuple[int, int]] = Counter()
        for i, state in self.automaton.matches(self.numbers(hashed), seed):
            for s, at in self.automaton.ends(state):
                hits[s, i - at] += 1
        enough = max(1, (least - seed + 1) - int(least * replaced + 1e-9) * seed)
        best: dict[int, tuple[int, int, float]] = {}
        for s, d in hits:
            if sum(hits.get((s, d + k), 0) for k in range(-DRIFT, DRIFT + 1)) < enough:
                continue
            a, b = longest(self.passages[s], hashed, d, least, replaced)
            if b - a > best.get(self.ids[s], (0, 0, 0.0))[1] - best.get(self.ids[s], (0, 0, 0.0))[0]:
                start, end = max(0, a + d), min(len(hashed), b + d)
                best[self.ids[s]] = (start, end, (b - a) / len(self.passages[s]))
        return [(item, *found) for item, found in sorted(best.items())]


def longest(passage: np.ndarray, doc: np.ndarray, offset: int, least: int, replaced: float) -> tuple[int, int]:
    """Start and end in the passage of its longest stretch, of ``least`` words or more, found at the offset with no
    more than that share of words replaced; (0, 0) if none. Replaced words at its edges are not part of it."""
    n = len(passage)
    same = np.zeros(n, bool)
    for d in range(offset - DRIFT, offset + DRIFT + 1):
        a, b = max(0, -d), min(n, len(doc) - d)
        if b > a:
            same[a:b] |= passage[a:b] == doc[a + d : b + d]
    if same.sum() < least * (1 - replaced):
        return 0, 0
    score = np.concatenate([[0], np.cumsum(np.where(same, replaced, replaced - 1))])
    # For each end, the first start whose score is no higher; those are where the lowest score so far is reached.
    lowest = np.minimum.accumulate(score)
    start = np.searchsorted(-lowest, -score - 1e-9, "left")
    length = np.arange(n + 1) - start
    end = int(np.argmax(length))
    if length[end] < least:
        return 0, 0
    found = np.flatnonzero(same[start[end] : end])
    return int(start[end] + found[0]), int(start[end] + found[-1] + 1)


_held: OrderedDict[str, Items] = OrderedDict()
_SPAN = "doc_id long, item_id long, first_word int, last_word int, first_char int, last_char int, words int, leaked int, coverage double"


def _find(key: str, block, seed: int, least: int, replaced: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            ids, passages = block.value
            _held[key] = Items(ids, [np.frombuffer(x, np.uint64) for x in passages], seed)
            while len(_held) > 2:
                _held.popitem(last=False)
        items = _held[key]
        kinds = [pa.int64()] * 2 + [pa.int32()] * 6 + [pa.float64()]
        for b in batches:
            out: list[tuple] = []
            doc_ids = b.column("id")
            for whole in cp.passes(b.column("text")):
                p, kept = plain(whole)
                start, end, first = cp.words(p)
                hashed = cp.word_hashes(p, start, end)
                runs, bound = cp.runs(hashed, first, seed)
                at = np.minimum(np.searchsorted(items.runs, runs), max(len(items.runs) - 1, 0))
                hit = np.flatnonzero(items.runs[at] == runs) if len(items.runs) else np.zeros(0, np.int64)
                for i in np.unique(np.searchsorted(bound, hit, "right") - 1):
                    lo, hi = first[i], first[i + 1]
                    for item, a, z, coverage in items.leaks(hashed[lo:hi], seed, least, replaced):
                        char = kept[start[lo + a]] - whole.off[i], kept[end[lo + z - 1] - 1] + 1 - whole.off[i]
                        out.append((doc_ids[int(p.i + i)].as_py(), item, a, z, *map(int, char), int(hi - lo), z - a, coverage))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            names = [c.split()[0] for c in _SPAN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return run


def leaked_spans(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 5,
    least: int = 20, replaced: float = 0.1,
) -> DataFrame:
    """One row for each document and item whose passage it holds: the longest leaked stretch in words and characters of
    the document, the document's words, the stretch's words, and its share of the passage."""
    spark = docs.sparkSession
    ids, passages = [], []
    wanted = items.select("item_id", "passage").filter("item_id is not null and passage is not null").orderBy("item_id")
    for row in wanted.toLocalIterator():
        p, _ = plain(next(cp.passes(pa.array([row[1]]))))
        start, end, _ = cp.words(p)
        if len(start):
            ids.append(int(row[0]))
            passages.append(cp.word_hashes(p, start, end))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.filter("id is not null and text is not null")
    out, i = None, 0
    while i < len(ids):
        j, words = i, 0
        while j < len(ids) and (j == i or words + len(passages[j]) <= BLOCK_WORDS):
            words += len(passages[j])
            j += 1
        sums = int(np.concatenate(passages[i:j]).sum())
        key = f"{spark.sparkContext.applicationId}-{hash(tuple(ids[i:j]))}-{sums}-{seed}"
        block = spark.sparkContext.broadcast((ids[i:j], [x.tobytes() for x in passages[i:j]]))
        found = rows.mapInArrow(_find(key, block, seed, least, replaced), _SPAN)
        out = found if out is None else out.unionAll(found)
        i = j
    return out if out is not None else spark.createDataFrame([], _SPAN)


def leaked_items(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """(doc_id, item_id, leaked, coverage): each document and item whose passage it holds, with the longest stretch."""
    spans = leaked_spans(docs, items, **settings)
    return spans.groupBy("doc_id", "item_id").agg(F.max("leaked").alias("leaked"), F.max("coverage").alias("coverage"))


def cleaned(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_share: float = 0.5, **settings
) -> DataFrame:
    """(doc_id, text, words, removed_words, whole): every document without its leaked spans.

    Spans that overlap are removed as one. A document of whose words more than ``most_share`` would go is removed
    whole: its text is null. Texts without leaks stay as they are; repeated ids lose the spans of either.
    """
    spans = written(leaked_spans(docs, items, id_col, text_col, **settings))
    of_doc = spans.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("first_char", "last_char", "first_word", "last_word"))).alias("spans"),
        F.max("words").alias("words"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("word"), F.lit("").alias("out"), F.lit(0).alias("removed"))
    text = F.col(text_col)

    def without(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["first_char"] - acc["at"], F.lit(0)))
        removed = acc["removed"] + F.greatest(s["last_word"] - F.greatest(s["first_word"], acc["word"]), F.lit(0))
        return F.struct(
            F.greatest(acc["at"], s["last_char"]).alias("at"),
            F.greatest(acc["word"], s["last_word"]).alias("word"),
            F.concat(acc["out"], gap).alias("out"),
            removed.alias("removed"),
        )

    kept = F.aggregate("spans", start, without)
    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).join(of_doc, "doc_id", "left")
    joined = joined.withColumn("_k", F.when(F.col("spans").isNotNull(), kept))
    rest = F.concat(F.col("_k.out"), F.substring(text, F.col("_k.at") + 1, 2_000_000_000))
    removed = F.coalesce(F.col("_k.removed"), F.lit(0))
    whole = F.coalesce(removed > F.col("words") * most_share, F.lit(False))
    clean = F.when(whole, None).when(F.col("spans").isNotNull(), rest).otherwise(text)
    return joined.select("doc_id", clean.alias("text"), removed.alias("removed_words"), whole.alias("whole"))
