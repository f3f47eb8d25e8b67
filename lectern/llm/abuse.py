"""Abusive, hateful or sexually explicit language, scored document by document.

Method: a bidirectional gated recurrent network with attention pooling, trained here in numpy. A word's
input is the sum of its own vector and the mean of vectors of its character trigrams, so unusual spellings
land near usual ones. Documents are cut into windows of ``WINDOW`` words that overlap by half; every window
is scored and a document's score is its highest.

Judgements name documents, not passages, and some are wrong. Two networks are first fitted on half of the
documents each, where the positive windows of documents judged abusive are those whose words stand out in
other such documents. Each scores the other half; the windows it confirms are the positives of the final
network, windows of the others its negatives, and documents whose judgement they clearly contradict are left
out. The final network is then run over all windows of the clean documents, and those it takes for abusive are
learned again, ``MINED`` times over. All networks together are fitted on at most
``LABELLED`` judged documents (those with the smallest hashes of their ids); every document is scored.

Defined results: null or empty texts score 0; several judgements of one document count as abusive if more
than half say so, ties as abusive; null judgements count for nothing; without any abusive judgement all scores
are 0; repeated ids get one row each; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.lookalike import LOOKS_LIKE
from lectern.plans.stage import bounded_sample, written

WINDOW, STEP = 32, 16
LABELLED = 6000
#: Windows of clean documents learned at first, the highest-scoring third of them by score; the rounds after that
#: look at all such windows of the judged documents.
NEGATIVES = 9000
MINED = 2
#: With fewer documents judged abusive, those whose words stand out far are kept though the half networks miss them,
#: and the threshold is not fitted.
FEW = 200
EMBED, HIDDEN, ATTEND, BUCKETS = 20, 10, 10, 8192
#: Words whose inputs a worker keeps; beyond that it starts anew.
KEPT_WORDS = 300_000
#: Windows scored at a time; their gates stay in cache.
BATCH = 512

# Digits and signs that stand for letters inside words.
LEET = str.maketrans("013457@", "oieasta")
_LATIN = str.maketrans({c: latin for latin, others in LOOKS_LIKE.items() for c in others})
_SPACED = re.compile(r"(?<!\S)(?:\w[ .\-_*]){3,}\w(?!\w)")
_EDGE = re.compile(r"^[^\w*$@#]+|[^\w*$@#]+$")
_INNER = re.compile(r"[.\-_·|/\\]")
_REPEAT = re.compile(r"(\w)\1{2,}")


def normal_word(raw: str) -> str:
    """A word in plain letters: styled and look-alike letters mapped, digits and signs among letters read as letters, stretched letters shortened."""
    if not raw.isascii():
        raw = "".join(c for c in unicodedata.normalize("NFKC", raw).translate(_LATIN) if unicodedata.category(c) != "Cf")
    word = _EDGE.sub("", raw.lower())
    if not word:
        return ""
    if word.isalpha():
        return _REPEAT.sub(r"\1", word)
    if not any(c.isalpha() for c in word):
        return "<num>" if any(c.isdigit() for c in word) else ""
    if len(_INNER.findall(word)) * 2 >= len(word) - 2:
        word = _INNER.sub("", word)
    if re.search(r"[^\W\d_][\d@]|[\d@][^\W\d_]", word) and not re.fullmatch(r"\d+\w{1,2}", word):
        word = word.translate(LEET)
    return _REPEAT.sub(r"\1", re.sub(r"[*$#!%]", "*", word))


def split_words(text: str) -> list[str]:
    """The words of a text, letters written apart brought together."""
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    return text.split()


def trigrams(word: str) -> list[int]:
    w = f"^{word}$"
    out = []
    for i in range(len(w) - 2):
        h = 2166136261
        for c in w[i : i + 3]:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        out.append((h ^ (h >> 15)) % BUCKETS)
    return out or [0]


def windows(n: int) -> list[tuple[int, int]]:
    """Start and end of the windows of a text of n words; together they cover it, each but the last as long as the others."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STEP)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(0.5 * x)
    x += 1
    x *= 0.5
    return x


def segment_sum(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their index below ``n``: sorted and added in runs, many times faster than adding one by one."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    """Two gated recurrent layers, one in each direction, attention over their states, one output."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        g = lambda *shape: (rng.standard_normal(shape) * (0.6 / np.sqrt(shape[0]))).astype(np.float32)
        h = HIDDEN
        self.p = {"word": (0.1 * rng.standard_normal((len(vocabulary) + 1, EMBED))).astype(np.float32), "chars": (0.1 * rng.standard_normal((BUCKETS, EMBED))).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": g(EMBED, 3 * h), f"U{d}": g(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": g(2 * h, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": g(ATTEND, 1)[:, 0], "o": g(2 * h, 1)[:, 0], "c": np.full(1, -1, np.float32)}
        self.p["word"][0] = 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def inputs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), EMBED), np.float32)
        for i, w in enumerate(words):
            if w:
                out[i] = self.p["word"][self.vocabulary.get(w, 0)] + self.p["chars"][trigrams(w)].mean(axis=0)
        return out

    @staticmethod
    def _run(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction. gates: (time, batch, 3 hidden), the input's part. ``mask`` is 0 where a window has ended."""
        h = HIDDEN
        state = np.zeros((gates.shape[1], h), np.float32)
        states = np.empty((len(gates), gates.shape[1], h), np.float32)
        held = []
        uzr, un = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        for t in range(len(gates)):
            zr = state @ uzr
            zr += gates[t, :, : 2 * h]
            zr = _sigmoid(zr)
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            n = rs @ un
            n += gates[t, :, 2 * h :]
            np.tanh(n, out=n)
            z = z * mask[t][:, None]
            if keep:
                held.append((state, z, r, n, rs))
            state = state + z * (n - state)
            states[t] = state
        return states, held

    def forward(self, x: np.ndarray, mask: np.ndarray, gates: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = False):
        """Probabilities of windows; x: (time, batch, EMBED), or the input's part of the gates of both directions."""
        p = self.p
        gf, gb = gates if gates is not None else (x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"])
        sf, hf = self._run(gf, p["Uf"], mask, keep)
        sb, hb = self._run(gb[::-1], p["Ub"], mask[::-1], keep)
        s = np.concatenate([sf, sb[::-1]], axis=2)
        att = np.tanh(s @ p["A"] + p["a"])
        e = att @ p["v"]
        e = np.where(mask > 0, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w = w / w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, s)
        y = _sigmoid(pooled @ p["o"] + p["c"])
        return (y, (x, mask, hf, hb, s, att, w, pooled)) if keep else y

    def _back(self, d: str, held: list, ds: np.ndarray, x: np.ndarray, mask: np.ndarray, grad: dict) -> np.ndarray:
        h, u, w = HIDDEN, self.p[f"U{d}"], self.p[f"W{d}"]
        carry = np.zeros_like(ds[0])
        dgates = np.empty((len(ds), ds.shape[1], 3 * h), np.float32)
        du = np.zeros_like(u)
        for t in range(len(ds) - 1, -1, -1):
            state, z, r, n, rs = held[t]
            dy = ds[t] + carry
            dn = dy * z * (1 - n * n)
            m = mask[t][:, None]
            zz = np.divide(z, m, out=np.zeros_like(z), where=m > 0)
            dz = dy * (n - state) * m * zz * (1 - zz)
            drs = dn @ u[:, 2 * h :].T
            dr = drs * state * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            dgates[t, :, : 2 * h], dgates[t, :, 2 * h :] = dzr, dn
            du[:, : 2 * h] += state.T @ dzr
            du[:, 2 * h :] += rs.T @ dn
            carry = dy * (1 - z) + drs * r + dzr @ u[:, : 2 * h].T
        grad[f"U{d}"] = du
        grad[f"W{d}"] = np.tensordot(x, dgates, axes=([0, 1], [0, 1]))
        grad[f"c{d}"] = dgates.sum(axis=(0, 1))
        return dgates @ w.T

    def step(self, word: np.ndarray, grams: list[list[int]], at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One step of Adam. ``word`` and ``grams``: vocabulary number and trigrams of each distinct word; ``at``: (time, batch) into those."""
        p = self.p
        size = np.array([len(g) for g in grams])
        flat = np.concatenate([np.asarray(g) for g in grams])
        owner = np.repeat(np.arange(len(grams)), size)
        table = p["word"][word].copy()
        table += np.add.reduceat(p["chars"][flat], np.cumsum(size) - size, axis=0) / size[:, None]
        x = table[at] * mask[:, :, None]
        prob, (x, mask, hf, hb, s, att, w, pooled) = self.forward(x, mask, keep=True)
        d = ((prob - y) * weight / len(y)).astype(np.float32)
        grad: dict[str, np.ndarray] = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["o"]
        dw = np.einsum("bh,tbh->tb", dpool, s)
        ds = w[:, :, None] * dpool[None]
        de = w * (dw - (w * dw).sum(axis=0))
        datt = de[:, :, None] * p["v"] * (1 - att * att)
        grad["v"] = np.einsum("tb,tba->a", de, att)
        grad["A"] = np.tensordot(s, datt, axes=([0, 1], [0, 1]))
        grad["a"] = datt.sum(axis=(0, 1))
        ds = ds + datt @ p["A"].T
        dx = self._back("f", hf, ds[:, :, :HIDDEN], x, mask, grad)
        dx = dx + self._back("b", hb, ds[::-1, :, HIDDEN:], x[::-1], mask[::-1], grad)[::-1]
        dx = dx * mask[:, :, None]
        dtable = segment_sum(at.reshape(-1), dx.reshape(-1, EMBED).astype(np.float32), len(table))
        rows, inverse = np.unique(flat, return_inverse=True)
        dchars = segment_sum(inverse, (dtable / size[:, None]).astype(np.float32)[owner], len(rows))
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            self._adam(k, slice(None), g, rate * fix)
        words, inverse = np.unique(word, return_inverse=True)
        dword = segment_sum(inverse, dtable, len(words))
        self._adam("word", words, dword, rate * fix)
        self._adam("chars", rows, dchars, rate * fix)
        self.p["word"][0] = 0
        return float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean())

    def _adam(self, k: str, rows, g: np.ndarray, rate: float) -> None:
        self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
        self.s[k][rows] = 0.999 * self.s[k][rows] + 0.001 * g * g
        self.p[k][rows] -= (rate * self.m[k][rows] / (np.sqrt(self.s[k][rows]) + 1e-6)).astype(np.float32)


class Scorer:
    """Scores whole documents with a trained network; keeps the input's part of the gates of each distinct raw word."""

    def __init__(self, network: Network):
        self.net = network
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.gates = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in "fb"]
        self._gates_of(0, [""])
        self.used = 1

    def _gates_of(self, first: int, words: list[str]) -> None:
        x = self.net.inputs(words)
        for g, d in zip(self.gates, "fb"):
            g[first : first + len(words)] = x @ self.net.p[f"W{d}"] + self.net.p[f"c{d}"]

    def numbers(self, raw: list[str]) -> np.ndarray:
        get = self.at.get
        out = [get(w, -1) for w in raw]
        if -1 in out:
            new = list(dict.fromkeys(w for w, i in zip(raw, out) if i < 0))
            if self.used + len(new) > KEPT_WORDS:
                self._clear()
                new = list(dict.fromkeys(raw))
            need = self.used + len(new)
            if need > len(self.gates[0]):
                self.gates = [np.concatenate([g, np.zeros((need, 3 * HIDDEN), np.float32)]) for g in self.gates]
            self._gates_of(self.used, [normal_word(w) for w in new])
            self.at |= {w: self.used + i for i, w in enumerate(new)}
            self.used = need
            out = [self.at[w] for w in raw]
        return np.array(out, np.int32)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each document's score, and the scores of its windows."""
        words = [split_words(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words])
        spans = [windows(n) for n in sizes]
        flat = self.numbers([w for doc in words for w in doc])
        base = np.concatenate([[0], np.cumsum(sizes)])
        start = np.array([base[i] + s for i, ws in enumerate(spans) for s, _ in ws], np.int64)
        length = np.array([e - s for ws in spans for s, e in ws], np.int64)
        prob = np.zeros(len(start), np.float32)
        for a in range(0, len(start), BATCH):
            at = start[a : a + BATCH][None, :] + np.arange(WINDOW)[:, None]
            mask = (np.arange(WINDOW)[:, None] < length[a : a + BATCH][None, :]).astype(np.float32)
            number = np.where(mask > 0, flat[np.minimum(at, len(flat) - 1)], 0)
            prob[a : a + BATCH] = self.net.forward(None, mask, gates=tuple(g[number] for g in self.gates))
        count = [len(ws) for ws in spans]
        each = np.split(prob, np.cumsum(count)[:-1]) if count else []
        return np.array([w.max() if len(w) else 0.0 for w in each]), each


class _Judged:
    """Judged documents cut into windows, with each distinct word's number, trigrams and counts."""

    def __init__(self, texts: list[str], abusive: list[bool]):
        self.texts, self.y = texts, np.array(abusive, bool)
        docs = [[normal_word(w) for w in split_words(t)] for t in texts]
        counts: dict[str, list[int]] = {}
        for words, flag in zip(docs, self.y):
            for w in set(words):
                counts.setdefault(w, [0, 0])[int(flag)] += 1
        self.names = list(counts)
        number = {w: i for i, w in enumerate(self.names)}
        self.counts = np.array([counts[w] for w in self.names])
        self.vocabulary = sorted(w for w, (a, b) in counts.items() if w and a + b >= 3)
        self.grams = [trigrams(w) if w else [0] for w in self.names]
        self.of = [np.array([number[w] for w in d], np.int64) for d in docs]
        self.span = [(i, s, e) for i, d in enumerate(docs) for s, e in windows(len(d))]
        self.owner = np.array([i for i, _, _ in self.span])

    def odds(self) -> np.ndarray:
        """Of each window of a document judged abusive: how far its words stand out in other such documents."""
        clean, bad = self.counts[:, 0], self.counts[:, 1] - 1
        weight = np.where(bad >= 1, np.maximum(np.log((np.maximum(bad, 0) + 0.05) / self.y.sum()) - np.log((clean + 0.5) / ((~self.y).sum() + 1)) - 1, 0), 0)
        weight[[i for i, w in enumerate(self.names) if not w]] = 0
        return np.array([weight[np.unique(self.of[i][s:e])].sum() if self.y[i] else 0.0 for i, s, e in self.span])

    def fit(self, net: Network, chosen: np.ndarray, positive: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        word = np.array([net.vocabulary.get(w, 0) for w in self.names])
        target = positive[chosen].astype(np.float32)
        heavy = float(np.clip((len(chosen) - target.sum()) / max(target.sum(), 1) / 3, 1, 8))
        for epoch in range(epochs):
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), 128):
                rows = order[a : a + 128]
                part = [self.of[self.span[r][0]][self.span[r][1] : self.span[r][2]] for r in chosen[rows]]
                used, back = np.unique(np.concatenate(part), return_inverse=True)
                at = np.zeros((WINDOW, len(rows)), np.int64)
                mask = np.zeros((WINDOW, len(rows)), np.float32)
                pos = 0
                for j, w in enumerate(part):
                    at[: len(w), j] = back[pos : pos + len(w)]
                    mask[: len(w), j] = 1
                    pos += len(w)
                # Some words are known by their characters alone, as unseen words will be.
                known = np.where(rng.random(len(used)) < 0.3, 0, word[used])
                net.step(known, [self.grams[i] for i in used], at, mask, target[rows], np.where(target[rows] > 0, heavy, 1).astype(np.float32), 0.01 if epoch + 1 < epochs else 0.004)


def train(texts: list[str], abusive: list[bool], seed: int = 7, epochs: int = 5, negatives: int = NEGATIVES) -> Network | None:
    """A network fitted on judged documents; None if none is judged abusive. Copies count once."""
    once: dict[str, list[bool]] = {}
    for t, flag in zip(texts, abusive):
        once.setdefault(t, []).append(bool(flag))
    data = _Judged(list(once), [sum(f) * 2 >= len(f) for f in once.values()])
    y, owner = data.y, data.owner
    if not y.any():
        return None
    rng = np.random.default_rng(seed)
    odds = data.odds()

    def pick(score: np.ndarray, part: np.ndarray, floor: float, trust: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.zeros(len(y))
        np.maximum.at(best, owner, score)
        positive = y[owner] & trust[owner] & part[owner] & (score >= floor) & (score >= 0.6 * best[owner])
        negative = np.flatnonzero(~y[owner] & trust[owner] & part[owner])
        hard = negative[np.argsort(-score[negative], kind="stable")[: most // 3]]
        other = rng.permutation(negative)[: most - len(hard)]
        return np.unique(np.concatenate([np.flatnonzero(positive), hard, other])), positive

    everything = np.ones(len(y), bool)
    half = rng.permutation(len(y)) % 2 == 0
    score = np.zeros(len(owner))
    for part in (half, ~half):
        net = Network(data.vocabulary, seed)
        chosen, positive = pick(odds, part, 3.0, everything, negatives // 2)
        data.fit(net, chosen, positive, epochs - 1, rng)
        rest = np.flatnonzero(~part)
        score[np.isin(owner, rest)] = np.concatenate(Scorer(net).score([data.texts[i] for i in rest])[1] or [np.zeros(0)])
    best = np.zeros(len(y))
    np.maximum.at(best, owner, score)
    stands = np.zeros(len(y))
    np.maximum.at(stands, owner, odds)
    trust = np.where(y, (best > 0.3) | ((stands > 5) & (y.sum() < FEW)), best < 0.9)
    score = np.where((best[owner] <= 0.3) & y[owner], np.minimum(odds / 5, 1), score)
    net = Network(data.vocabulary, seed)
    chosen, positive = pick(score, everything, 0.3, trust, negatives)
    data.fit(net, chosen, positive, epochs, rng)
    clean = np.flatnonzero(~y & trust)
    windows_of_clean = np.flatnonzero(np.isin(owner, clean))
    for _ in range(MINED if len(clean) else 0):
        now = np.concatenate(Scorer(net).score([data.texts[i] for i in clean])[1] or [np.zeros(0)])
        taken = windows_of_clean[now > 0.1]
        chosen = np.unique(np.concatenate([chosen, taken]))
        again = np.concatenate([chosen, np.repeat(taken, 3)])
        data.fit(net, again, positive, 2, rng)
    # The threshold that the held-out scores of the half networks call for becomes the score 0.5.
    limit = held_out_threshold(best, y) if y.sum() >= FEW else 0.5
    net.p["c"] = (net.p["c"] - np.log(limit / (1 - limit))).astype(np.float32)
    return net


def held_out_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The highest threshold from 0.5 to 0.98 whose F1 on held-out documents is within half a hundredth of the best."""
    tried = np.array([0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98])
    f1 = np.array([2 * (y & (score >= t)).sum() / max((score >= t).sum() + y.sum(), 1) for t in tried])
    return float(tried[f1 >= f1.max() - 0.005][-1])


def saved(net: Network, path: str) -> None:
    """Writes a fitted network to one file, for ``loaded``."""
    words = np.array(sorted(net.vocabulary, key=net.vocabulary.get), dtype=np.str_)
    np.savez_compressed(path, vocabulary=words, **net.p)


def loaded(path: str) -> Network:
    with np.load(path, allow_pickle=False) as f:
        net = Network(f["vocabulary"].tolist())
        net.p = {k: f[k] for k in net.p}
    return net


_scorers: dict[str, Scorer] = {}


def _score(key: str, sent):
    """``sent``: the broadcast network, or None where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value if sent is not None else None
        if net is not None and key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(net)
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                value = _scorers[key].score(part.column("text").to_pylist())[0] if net is not None else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source"), pa.array(value.astype(np.float64))], names=["id", "source", "score"])

    return run


def judged(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[list[str], list[bool]]:
    """Texts and judgements of at most ``most`` judged documents."""
    votes = labels.filter("toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("abusive"))
    some = bounded_sample(written(votes), "doc_id", most)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", "text", "abusive").toPandas().sort_values(["doc_id", "text"])
    return rows["text"].tolist(), rows["abusive"].tolist()


def scored(docs: DataFrame, labels: DataFrame, most: int = LABELLED, net: Network | None = None) -> DataFrame:
    """(doc_id, source, score) of every document. ``net``: a network fitted before; else one is fitted to ``labels``."""
    net = net or train(*judged(docs, labels, most))
    sent = docs.sparkSession.sparkContext.broadcast(net) if net is not None else None
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "source", "text")
    out = rows.mapInArrow(_score(uuid.uuid4().hex, sent), "id long, source string, score double")
    return out.withColumnRenamed("id", "doc_id")


def rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of flagged documents by source."""
    hit = (F.col("score") >= threshold).cast("long")
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(hit).alias("flagged"), F.avg(hit.cast("double")).alias("share"), F.avg("score").alias("mean_score"))
