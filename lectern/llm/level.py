"""The reading level of texts, in school years.

Method: gradient-boosted regression trees, trained here in numpy, over distributions of sentence length,
word length and syllables, vocabulary, clause words and cohesion. The grade they learn is the consensus of
four published readability formulas (Flesch-Kincaid, ARI, Coleman-Liau, Gunning fog) on texts whose
sentences are marked; each such text is also learned without its punctuation and line breaks, so that
grades hold for texts that lost theirs. Predictions are calibrated by a monotone fit (isotonic regression)
to held-out predictions. In cross-validation whole sources are held out, from the trees and from the
calibration alike, and the errors are those of all texts of a source.

The model is fitted on ``SAMPLE`` texts, those with the smallest hashes of their ids; every text is graded.
Characters that show nothing are left out and look-alike letters count as the letters they resemble.

Defined results: null texts and texts of fewer words than asked have no grade; texts without words likewise;
repeated rows get the same grade; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import codepoints as cp
from lectern.llm.lookalike import LOOKS_LIKE
from lectern.plans.stage import bounded_sample

#: Texts the model is fitted on, at most.
SAMPLE = 4000
#: A text below grade EASY can be followed in the third school year; from HARD on it needs more than twelve.
EASY, HARD = 3.5, 13.5

CLAUSES = "after although as because before even except how however if in insofar lest may nor notwithstanding once provided since so than that though unless until upon what when whenever where whereas whereby whether which while who whoever whom whose why yet".split()
CHAINS = "and but or so then too now".split()
PERSONS = "i you he she it we they me him her us them my your his our their mine yours".split()
ARTICLES = "the a an this these those".split()
FEATURES = [
    "words", "chars_word", "syl_word", "len_sd", "syl_sd", *(f"len_ge_{n}" for n in (5, 7, 9, 11, 13)), *(f"syl_ge_{n}" for n in (2, 3, 4, 5)),
    "sent_mean", "sent_sd", "sent_max", "unmarked", "commas", "clauses", "chains", "persons", "articles", "distinct", "near_repeats", "digits",
]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether it shows nothing; whether it is a vowel; the plain small letter it looks like, or 0."""
    alike = {ord(c): ord(latin.lower()) for latin, others in LOOKS_LIKE.items() for c in others}
    n = cp.TOP
    drop, letter = np.zeros(n, bool), np.zeros(n, np.uint8)
    for i in range(n):
        ch = chr(i)
        kind = unicodedata.category(ch)
        drop[i] = kind in ("Cf", "Mn", "Me")
        if kind[0] == "L":
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            letter[i] = alike.get(i) or alike.get(ord(base)) or (ord(base) if "a" <= base <= "z" else 0)
    return drop, np.isin(letter, [ord(c) for c in "aeiouy"]), letter


@cache
def _lists() -> list[np.ndarray]:
    return [np.sort(np.array([cp.hash_word(w) for w in words], np.uint64)) for words in (CLAUSES, CHAINS, PERSONS, ARTICLES)]


def _per(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return c[bound[1:]] - c[bound[:-1]]


def features(p: cp.Pass, strip: bool = False) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a pass. ``strip``: as if punctuation and line breaks were lost."""
    drop, vowel, letter = _letters()
    gone = drop[p.at]
    if gone.any():
        p = cp.Pass(p.i, p.j, p.code[~gone], np.concatenate([[0], np.cumsum(~gone)])[p.off])
    start, end, first = cp.words(p)
    n = np.diff(first).astype(float)
    div = np.maximum(n, 1)
    out = np.zeros((len(n), len(FEATURES)))
    if not len(start):
        return out
    hashed = cp.word_hashes(p, start, end)
    length = (end - start).astype(float)
    v = vowel[p.at]
    begins = v & ~np.concatenate([[False], v[:-1]])
    begins[start] = v[start]
    groups = np.concatenate([[0], np.cumsum(begins)])
    syl = (groups[end] - groups[start]).astype(float)
    # A silent e at the end, alone or before s or d.
    low = letter[p.at]
    last, prev, third = low[end - 1], low[np.maximum(end - 2, 0)], low[np.maximum(end - 3, 0)]
    silent = (length > 3) & (((last == ord("e")) & ~v[np.maximum(end - 2, 0)] & (prev != ord("l"))) | (((last == ord("s")) | (last == ord("d"))) & (prev == ord("e")) & ~v[np.maximum(end - 3, 0)] & ~np.isin(third, [ord(c) for c in "tdszc"])))
    syl = np.maximum(syl - silent, 1)
    mean_len, mean_syl = _per(length, first) / div, _per(syl, first) / div
    columns = [n, mean_len, mean_syl]
    columns += [np.sqrt(np.maximum(_per(x * x, first) / div - m * m, 0)) for x, m in ((length, mean_len), (syl, mean_syl))]
    columns += [_per(length >= k, first) / div for k in (5, 7, 9, 11, 13)] + [_per(syl >= k, first) / div for k in (2, 3, 4, 5)]
    # Sentences end where a stop, or a line break, stands between two words.
    stop = np.zeros(len(p.code), bool) if strip else np.isin(p.code, [ord(c) for c in ".!?…。．？！\n"])
    stops = np.concatenate([[0], np.cumsum(stop)])
    nxt = np.concatenate([start[1:], [len(p.code)]])
    closes = stops[nxt] > stops[end]
    closes[first[1:][n > 0] - 1] = True
    owner = np.repeat(np.arange(len(n)), np.diff(first))
    ends = np.flatnonzero(closes)
    size = np.diff(np.concatenate([[-1], ends])).astype(float)
    of = owner[ends]
    count = np.bincount(of, minlength=len(n)).astype(float)
    mean = n / np.maximum(count, 1)
    square = np.bincount(of, size * size, minlength=len(n)) / np.maximum(count, 1)
    longest = np.zeros(len(n))
    np.maximum.at(longest, of, size)
    unmarked = longest > 60
    columns += [np.where(unmarked, -1, mean), np.where(unmarked, -1, np.sqrt(np.maximum(square - mean * mean, 0))), np.where(unmarked, -1, longest), unmarked.astype(float)]
    comma = np.zeros(len(p.code), bool) if strip else np.isin(p.code, [ord(c) for c in ",;:，；()"])
    columns.append(_per(comma, p.off) / div)
    for words in _lists():
        at = np.minimum(np.searchsorted(words, hashed), len(words) - 1)
        columns.append(_per(words[at] == hashed, first) / div)
    # Distinct words, and longer words said again within thirty words: cohesion.
    key = (hashed & ~np.uint64(0xFFFFF)) | owner.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    near = np.zeros(len(key), bool)
    near[order[1:][same & (np.diff(order) <= 30)]] = True
    columns += [1 - _per(again, first) / div, _per(near & (length > 4), first) / np.maximum(_per(length > 4, first), 1)]
    digit = (p.code >= 48) & (p.code < 58)
    columns.append(_per(digit, p.off) / div)
    return np.stack(columns, axis=1)


def formula_grades(x: np.ndarray) -> np.ndarray:
    """The consensus of four published formulas, each held to the range 0 to 20."""
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    sent = np.maximum(f["sent_mean"], 1)
    grades = [
        0.39 * sent + 11.8 * f["syl_word"] - 15.59,
        4.71 * f["chars_word"] + 0.5 * sent - 21.43,
        0.0588 * 100 * f["chars_word"] - 0.296 * 100 / sent - 15.8,
        0.4 * (sent + 100 * f["syl_ge_3"]),
    ]
    return np.mean([np.clip(g, 0, 20) for g in grades], axis=0)


class Boosted:
    """Gradient-boosted regression trees on binned features, squared loss; all nodes of a level are split at once."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 48, least: int = 12):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)
        self.start = float(y.mean())
        now = np.full(n, self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = self.bins + 1
        for _ in range(self.rounds):
            rest = y - now
            node = np.zeros(n, np.int64)
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                nodes = 2**level
                best = np.full(nodes, 1e-9)
                for j in range(k):
                    at = node * width + binned[:, j]
                    s = np.bincount(at, rest, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    c = np.bincount(at, minlength=nodes * width).reshape(nodes, width).cumsum(axis=1)
                    sl, cl = s[:, :-1], c[:, :-1]
                    sr, cr = s[:, -1:] - sl, c[:, -1:] - cl
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where((cl >= self.least) & (cr >= self.least), sl**2 / cl + sr**2 / cr - s[:, -1:] ** 2 / c[:, -1:], -1)
                    gain = gain[:, : len(self.cuts[j])]
                    if not gain.shape[1]:
                        continue
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), top]
                    for m in np.flatnonzero(value > best):
                        best[m] = value[m]
                        feature[nodes - 1 + m] = j
                        cut[nodes - 1 + m] = self.cuts[j][top[m]]
                f, t = feature[nodes - 1 + node], cut[nodes - 1 + node]
                node = 2 * node + (x[np.arange(n), f] >= t)
            total = np.bincount(node, minlength=2**self.depth)
            leaf = self.rate * np.bincount(node, rest, 2**self.depth) / np.maximum(total, 1)
            now = now + leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] >= cut[at])
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x, as knots for ``np.interp``."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            xa, ya, na = blocks.pop()
            xb, yb, nb = blocks.pop()
            blocks.append([(xa * na + xb * nb) / (na + nb), (ya * na + yb * nb) / (na + nb), na + nb])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fold_of(source: str, folds: int) -> int:
    return zlib.crc32(source.encode()) % folds


def band_of(grade: np.ndarray) -> np.ndarray:
    return np.where(grade < EASY, 0, np.where(grade >= HARD, 2, 1))


def is_marked(x: np.ndarray) -> np.ndarray:
    """Texts of 20 words or more whose sentences are marked: those the formulas can grade."""
    return (x[:, 0] >= 20) & (x[:, FEATURES.index("unmarked")] == 0) & (x[:, FEATURES.index("sent_mean")] > 0)


class LevelModel:
    def __init__(self, texts: list[str], sources: list[str], folds: int = 5):
        rows, bare = [], []
        for p in cp.passes(pa.array(texts, pa.string())):
            rows.append(features(p))
            bare.append(features(p, strip=True))
        x, stripped = (np.concatenate(r) if r else np.zeros((0, len(FEATURES))) for r in (rows, bare))
        marked = is_marked(x)
        x, stripped, source = x[marked], stripped[marked], np.array([s or "" for s in sources], object)[marked]
        y = formula_grades(x)
        self.cv = pd.DataFrame(columns=["source", "n", "mae", "bias", "band_agreement"])
        self.n_folds, self.folds, self.fold_knots = folds, {}, {}
        self.knots = (np.array([0.0, 20.0]), np.array([0.0, 20.0]))
        if len(y) < 50:
            self.model = Boosted(rounds=0).fit(x, y) if len(y) else None
            return
        self.model = Boosted().fit(np.concatenate([x, stripped]), np.concatenate([y, y]))
        # Whole sources are held out together; a fold's predictions are calibrated on those of the other folds.
        fold = np.array([fold_of(s, folds) for s in source])
        held = np.zeros((2, len(y)))
        for f in np.unique(fold):
            a, b = fold != f, fold == f
            if a.sum() < 50:
                held[:, b] = y[a].mean() if a.any() else y.mean()
                continue
            m = Boosted(rounds=60, rate=0.2).fit(np.concatenate([x[a], stripped[a]]), np.concatenate([y[a], y[a]]))
            held[0, b], held[1, b] = m.predict(x[b]), m.predict(stripped[b])
            self.folds[int(f)] = m
        self.knots = isotonic(held.reshape(-1), np.concatenate([y, y]))
        for f in self.folds:
            a = fold != f
            self.fold_knots[f] = isotonic(held[:, a].reshape(-1), np.concatenate([y[a], y[a]]))
        calibrated = np.array([np.interp(h, *self.fold_knots.get(int(f), self.knots)) for h, f in zip(held[0], fold)])
        frame = pd.DataFrame({"source": source, "error": calibrated - y, "agree": band_of(calibrated) == band_of(y)})
        self.cv = frame.groupby("source").agg(
            n=("error", "size"), mae=("error", lambda e: float(np.abs(e).mean())), bias=("error", "mean"),
            band_agreement=("agree", "mean"),
        ).reset_index()

    def held_out(self, x: np.ndarray, source: list[str | None]) -> np.ndarray:
        """Grades of texts by the model and calibration of the fold that never saw their source."""
        fold = np.array([fold_of(s or "", self.n_folds) for s in source], int)
        out = self.grade(x)
        for f, m in self.folds.items():
            rows = np.flatnonzero(fold == f)
            if len(rows):
                out[rows] = np.clip(np.interp(m.predict(x[rows]), *self.fold_knots[f]), 0, 20)
        return out

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.model.predict(x), *self.knots), 0, 20) if self.model else np.zeros(len(x))


def fitted(df: DataFrame, id_col: str, text_col: str, source_col: str, sample: int = SAMPLE) -> LevelModel:
    rows = bounded_sample(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "id", sample).filter("text is not null").toPandas()
    return LevelModel(rows["text"].tolist(), rows["source"].tolist())


def _grade(model: LevelModel, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in cp.passes(b.column("text")):
                x = features(p)
                rows = np.flatnonzero((cp.space_counts(p) >= least_words) & (x[:, 0] > 0))
                at = pa.array(p.i + rows)
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("register").take(at), pa.array(model.grade(x[rows]))], names=["id", "register", "grade"])

    return run


def graded(df: DataFrame, id_col: str = "row_id", text_col: str = "text", register_col: str = "register", source_col: str = "source", least_words: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(id, register, grade, band) of every text."""
    model = fitted(df, id_col, text_col, source_col, sample)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(F.col(register_col))).alias("register"), F.col(text_col).alias("text")).filter("text is not null")
    out = rows.mapInArrow(_grade(model, least_words), "id long, register string, grade double")
    return out.withColumn("band", F.when(F.col("grade") < EASY, "easy").when(F.col("grade") >= HARD, "hard").otherwise("middle"))


def _errors(model: LevelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column("source").to_pylist()
            for p in cp.passes(b.column("text")):
                x = features(p)
                rows = np.flatnonzero(is_marked(x))
                named = [sources[p.i + i] for i in rows]
                y, held = formula_grades(x[rows]), model.held_out(x[rows], named)
                agree = (band_of(held) == band_of(y)).astype(float)
                columns = [pa.array(named, pa.string()), pa.array(held - y), pa.array(agree)]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "error", "agree"])

    return run


def cross_validated(df: DataFrame, id_col: str, text_col: str, source_col: str, sample: int = SAMPLE) -> DataFrame:
    """(source, n, mae, bias, band_agreement) over all texts whose sentences are marked.

    The models are fitted on the bounded sample; each text is graded by the one that never saw its source, and
    calibrated without it.
    """
    model = fitted(df, id_col, text_col, source_col, sample)
    rows = df.select(F.col(source_col).alias("source"), F.col(text_col).alias("text")).filter("text is not null")
    errors = rows.mapInArrow(_errors(model), "source string, error double, agree double")
    return errors.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"),
        F.avg("agree").alias("band_agreement"),
    )


def profile(levels: DataFrame) -> DataFrame:
    """Levels by register: rows, mean and quartiles of the grade, shares of easy and hard."""
    return levels.groupBy("register").agg(F.count(F.lit(1)).alias("rows"), F.avg("grade").alias("mean_grade"), *(F.percentile_approx("grade", q, 1000).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)), F.avg((F.col("band") == "easy").cast("double")).alias("easy"), F.avg((F.col("band") == "hard").cast("double")).alias("hard"))
