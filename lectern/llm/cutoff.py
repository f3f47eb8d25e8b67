"""Texts cut off by a length limit or a broken transfer.

Method. (1) Of each source the lengths, in characters, bytes and words, follow a mixture of log-normal
distributions that is right-censored at the source's limits; it is fitted by maximum likelihood (EM on the
length histogram; the number of components by the Bayesian information criterion), limits being the lengths
with far more different texts than the fit allows. A value's censoring posterior at a candidate limit is the
share of the values at its length that the fitted distribution doesn't explain; of the three units the
highest counts.
(2) Ending evidence: each text falls into a cell by how it ends (closed sentence, open, dots, pause, unclosed
bracket or tag, ...), how often its last word ends sentences elsewhere in the corpus, how long the last
sentence is, and whether it looks like a sign-off. How cut texts end is measured on the texts at limits,
weighted by their censoring posterior; how complete texts end, on closed sentences. Among texts of one table
and source that end alike, the share of cut ones is found by EM between these two, shrunk to the share in
the whole table.
(3) Both are combined by Bayes' rule, and copies of one content share the mean of their log odds.

Defined results: null texts, texts of white space only and texts without a letter or digit are never cut; a
text with an explicit mark of a cut or ending in a broken character or escape always is; a null source is a
source of its own; repeated ids count once, cut if one of their texts is; empty tables give empty tables;
other columns are not read. What is gathered on the driver are cells, whose number does not grow with the
rows or sources.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import codepoints as cp
from lectern.plans.stage import partitions, written

#: What systems put where they cut.
MARK = re.compile(
    r"(?:[\[(<{]\s*(?:…|\.\.\.|more|read more|continued|cont(?:inue)?d?\.?|truncated|cut|snip(?:ped)?|shortened"
    r"|\+\s*\d+\s*(?:chars?|characters|words?|more)?|text (?:cut|truncated))\s*(?:…|\.\.\.)?\s*[\])>}]"
    r"|(?:…|\.\.\.)\s*(?:read|show|see) more)\s*$",
    re.IGNORECASE,
)
#: A character, entity or escape broken off.
BROKEN = re.compile(r"(?:�|&(?:#\w{0,6}|[a-z]{1,6})?|\\u?[0-9a-f]{0,3}|%[0-9A-F]?)$")
#: A tag or a link broken off.
UNCLOSED_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]{0,200})?$|(?:\(|\s)(?:see )?(?:ht|htt|https?|https?:/{0,2})$")
STOPS = ".!?…。．？！"
CLOSERS = "\"'”’»)]}>*_ \t\r\n;"
DOTS = re.compile(r"(?:\.\.\.|…)[\"'”’»)\]]*$")
LINK = re.compile(r"(?:https?://|www\.)\S+$")
CLOSED, LINKED, BRACKET, MARKED, BROKEN_END, OPEN, PAUSE, DOTTED, FIELD, UNCLOSED, SHORT = range(11)
#: Texts of fewer words without a closed sentence are a kind of their own.
FEW = 5
#: Endings at which a complete text and a cut one are told apart by their last words.
PLAIN = (OPEN, PAUSE, DOTTED, UNCLOSED)
TAIL = re.compile(rf"[{re.escape(STOPS)}\n][\"'”’»)\]]*\s+|\n")
LAST_FIELD = re.compile(r"(?:^|[;\n,{])\s*\"?([^\W\d]\w{0,30})\"?\s*[:=][^:=\n;]{0,120}$")
FACE = re.compile(r"[:;=8]['\-]?[(\[{<]")


def _unclosed(last: str) -> bool:
    last = FACE.sub("", last)
    return any(last.rfind(a) > last.rfind(b) for a, b in ("()", "[]", "{}"))


def ending(text: str) -> tuple[int, int, int, int]:
    """How a text ends.

    Its kind; the words of its last sentence (0 none, then 1, 2-3, 4-7, 8-15, more); whether those start in
    lower case after a sentence (2: the text has one case only); whether the text has closed sentences at all.
    """
    t = text.rstrip()
    if MARK.search(t):
        return MARKED, 0, 0, 1
    if BROKEN.search(t) or UNCLOSED_TAG.search(t):
        return BROKEN_END, 0, 0, 1
    bare = t.rstrip(CLOSERS)
    if t.lstrip().startswith(("{\"", "{\n", "{ ")) and not t.endswith("}"):
        return BROKEN_END, 0, 0, 1
    last = TAIL.split(t)[-1]
    words = len(last.split())
    size = 0 if not words else 1 if words == 1 else 2 if words < 4 else 3 if words < 8 else 4 if words < 16 else 5
    closes = any(s in bare[:-1] for s in ".!?。．？！")
    mixed = not (t.islower() or t.isupper() or t.istitle())
    lower = 2 if not mixed else int(closes and not (last[:1].isupper() or last[:1] in "\"'“‘«("))
    if DOTS.search(t):
        return DOTTED, size, lower, int(closes)
    if LINK.search(t):
        return LINKED, 0, 0, 1
    if bare and bare[-1] in STOPS:
        return CLOSED, size, 0, int(closes)
    if t[-1] in ")]}":
        return BRACKET, 0, 0, int(closes)
    if LAST_FIELD.search(t) and t.count("=") + t.count(":") > 1:
        return FIELD, size, lower, int(closes)
    if _unclosed(last):
        return UNCLOSED, size, lower, int(closes)
    return (OPEN if t[-1].isalnum() or t[-1] in "*_" else PAUSE), size, lower, int(closes)


_DOC = (
    "kind int, tab int, id long, source string, chars int, bytes int, words int, ends int, tail int, low int, "
    "stops int, word long, pair long, content long, inner long, final long"
)
_NAMES = [x.split()[0] for x in _DOC.split(", ")]


def _contents(p: cp.Pass) -> np.ndarray:
    """A hash of each text without white space, punctuation and case."""
    t = cp.tables()
    keep = ~t["loose"][p.at]
    code = np.where(p.code < cp.TOP, t["lower"][p.at], p.code)[keep]
    off = np.concatenate([[0], np.cumsum(keep)])[p.off]
    bare = cp.Pass(p.i, p.j, code.astype(np.uint32), off)
    return cp.word_hashes(bare, off[:-1], off[1:]).view(np.int64)


def _octets(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros(0, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.diff(np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: texts with lengths and endings; of kind 1: words of the batch, how often they stand before
    the last word, and how often before a stop."""
    stop_codes = np.array([ord(c) for c in STOPS + "\n"])
    for b in batches:
        tally: list[pd.DataFrame] = []
        texts, octets = b.column("text"), _octets(b.column("text"))
        for p in cp.passes(texts):
            start, end, first = cp.words(p)
            hashed = cp.word_hashes(p, start, end).view(np.int64)
            after = np.concatenate([p.code, [0]])[end]
            final = np.isin(after, stop_codes)
            inner = np.ones(len(start), bool)
            filled = np.flatnonzero(np.diff(first) > 0)
            inner[first[1:][filled] - 1] = False
            if len(start):
                value, at = np.unique(hashed, return_inverse=True)
                counts = {"inner": np.bincount(at, inner), "final": np.bincount(at, inner & final)}
                tally.append(pd.DataFrame({"word": value, **counts}))
            spaced = cp.space_counts(p)
            rows = np.flatnonzero((np.diff(p.off) > 0) & (spaced > 0))
            if not len(rows):
                continue
            n = np.diff(first)[rows]
            word, pair, with_words = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), n > 0
            word[with_words] = hashed[first[1:][rows[with_words]] - 1]
            pair[n > 1] = word[n > 1] * np.int64(31) + hashed[first[1:][rows[n > 1]] - 2]
            how = np.array([ending(texts[int(p.i + i)].as_py()) for i in rows], np.int32)
            wordless = ~with_words & ~np.isin(how[:, 0], (MARKED, BROKEN_END))
            how[wordless] = (CLOSED, 0, 0, 0)
            how[(n < FEW) & np.isin(how[:, 0], PLAIN) & (how[:, 3] == 0)] = (SHORT, 0, 0, 0)
            at, k = pa.array(p.i + rows), len(rows)
            ints = [np.diff(p.off)[rows], octets[p.i + rows], spaced[rows], *how.T]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(k, np.int32)),
                    *(b.column(c).take(at) for c in ("tab", "id", "source")),
                    *(pa.array(np.ascontiguousarray(x, np.int32)) for x in ints),
                    pa.array(word),
                    pa.array(pair),
                    pa.array(_contents(p)[rows]),
                    *(pa.nulls(k, pa.int64()) for _ in range(2)),
                ],
                names=_NAMES,
            )
        if tally:
            t = pd.concat(tally).groupby("word", as_index=False).sum()
            k = len(t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(k, np.int32)),
                    pa.nulls(k, pa.int32()),
                    pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.string()),
                    *(pa.nulls(k, pa.int32()) for _ in range(7)),
                    pa.array(t["word"].to_numpy()),
                    *(pa.nulls(k, pa.int64()) for _ in range(2)),
                    *(pa.array(t[c].to_numpy().astype(np.int64)) for c in ("inner", "final")),
                ],
                names=_NAMES,
            )


def _normal(z: np.ndarray) -> np.ndarray:
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _survival(z: np.ndarray) -> np.ndarray:
    return np.array([max(0.5 * math.erfc(v / math.sqrt(2)), 1e-12) for v in z.ravel()]).reshape(z.shape)


def censored_mixture(
    length: np.ndarray, count: np.ndarray, censored: np.ndarray, k: int, rounds: int = 40
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means and deviations of ``k`` log-normal components, and the log likelihood, by EM.

    ``censored`` of the counts at a length are only known to be at least that long.
    """
    x = np.log(length)
    seen, held = count - censored, np.flatnonzero(censored > 0)
    total = count.sum()
    order = np.cumsum(count) / total
    mu = np.interp((np.arange(k) + 0.5) / k, order, x)
    spread = max(0.05, math.sqrt(np.average((x - np.average(x, weights=count)) ** 2, weights=count)))
    sd, weight = np.full(k, spread / k + 0.02), np.full(k, 1 / k)
    likelihood = -math.inf
    for _ in range(rounds):
        z = (x[None, :] - mu[:, None]) / sd[:, None]
        density = weight[:, None] * _normal(z) / (sd[:, None] * length[None, :]) + 1e-300
        both = density.sum(0)
        likelihood = float((seen * np.log(both)).sum())
        r = density / both * seen
        zh = z[:, held]
        tail = _survival(zh)
        beyond = weight[:, None] * tail
        likelihood += float((censored[held] * np.log(beyond.sum(0) + 1e-300)).sum())
        rh = beyond / (beyond.sum(0) + 1e-300) * censored[held]
        hazard = np.minimum(_normal(zh) / tail, np.maximum(zh, 0) + 1)
        mean = mu[:, None] + sd[:, None] * hazard
        square = mu[:, None] ** 2 + sd[:, None] ** 2 + sd[:, None] * (x[held] + mu[:, None]) * hazard
        n = r.sum(1) + rh.sum(1) + 1e-9
        mu = ((r * x).sum(1) + (rh * mean).sum(1)) / n
        second = ((r * x * x).sum(1) + (rh * square).sum(1)) / n
        sd = np.sqrt(np.maximum(second - mu * mu, 0.03**2))
        weight = n / n.sum()
    return weight, mu, sd, likelihood


def censored_fit(length: np.ndarray, count: np.ndarray, censored: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Mean and deviation of log lengths where one log-normal is fitted."""
    _, mu, sd, _ = censored_mixture(length, count, censored, 1, rounds)
    return float(mu[0]), float(sd[0])


#: At most so many log-normal components a source.
COMPONENTS = 4


def find_limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source's histogram (length, n, different): its limits and the censoring posterior of values there."""
    pdf = pdf.groupby("length", as_index=False)[["n", "different"]].sum().sort_values("length")
    length, n, different = (pdf[c].to_numpy(float) for c in ("length", "n", "different"))
    censored = np.zeros(len(length))
    total = different.sum()
    # The level around a length: the median of the counts at the 50 lengths next to it, most of which may be 0.
    low, high = np.searchsorted(length, length - 25), np.searchsorted(length, length + 25, "right")
    is_limit, expected, natural = np.zeros(len(length), bool), np.zeros(len(length)), np.ones(len(length))
    components = 1
    for step in range(4):
        fits = []
        for k in range(1, COMPONENTS + 1) if step == 1 else [components]:
            w, mu, sd, ll = censored_mixture(length, different, censored, k)
            fits.append((-2 * ll + (3 * k - 1) * math.log(max(total, 2)), k, w, mu, sd))
        _, components, w, mu, sd = min(fits, key=lambda f: f[0])
        z = (np.log(length)[None, :] - mu[:, None]) / sd[:, None]
        expected = total * (w[:, None] * _normal(z) / (sd[:, None] * length[None, :])).sum(0)
        natural = expected.copy()
        for i in np.flatnonzero(different > np.maximum(4 * expected, expected + 4 * np.sqrt(expected + 1))):
            near = np.delete(different[low[i] : high[i]], i - low[i])
            level = np.sort(np.concatenate([near, np.zeros(max(0, 50 - len(near)))]))[-25:][0]
            natural[i] = max(expected[i], level)
        is_limit = different > np.maximum(4 * natural, natural + 5 * np.sqrt(natural + 1) + 2)
        censored = np.where(is_limit, different - natural, 0.0)
    out = pdf.assign(posterior=np.clip(1 - natural / different, 0, 0.999))[is_limit]
    return out[["length", "n", "posterior"]]


def _limits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    found = find_limits(pdf)
    found = found.assign(tab=key[0], source=key[1], unit=key[2], length=found["length"].astype("int32"))
    return found.assign(n=found["n"].astype("int64"))[["tab", "source", "unit", "length", "n", "posterior"]]


def measured(tabs: list[tuple[int, DataFrame, str]]) -> DataFrame:
    rows = None
    for tab, df, key in tabs:
        one = df.select(F.lit(tab).alias("tab"), F.col(key).cast("long").alias("id"), "source", "text")
        one = one.filter("id is not null and text is not null")
        rows = one if rows is None else rows.unionAll(one)
    return written(rows.mapInArrow(_measure, _DOC))


UNITS = ("chars", "bytes", "words")


def limits(docs: DataFrame) -> DataFrame:
    """(tab, source, unit, length, n, posterior): limits of length by source, in characters, bytes and words.

    Copies of one content and length count once, so that they make no limit.
    """
    source = F.coalesce("source", F.lit("")).alias("source")
    once = docs.groupBy("tab", source, "content", *UNITS).agg(F.count(F.lit(1)).alias("n"))
    units = F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS))
    each = once.select("tab", "source", "n", F.explode(units).alias("u")).select("tab", "source", "u.*", "n")
    histogram = each.groupBy("tab", "source", "unit", "length").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")
    )
    spread = histogram.repartition(partitions(docs.sparkSession), "tab", "source", "unit")
    return spread.groupBy("tab", "source", "unit").applyInPandas(
        _limits, "tab int, source string, unit string, length int, n long, posterior double"
    )


GROUP = ["ends", "low", "stops", "sign"]
CELL = [*GROUP, "tail", "seen"]
#: Upper bounds of the shares in which words end sentences, for the classes of ``seen`` from 2 on; 0: rare, 1: never.
SHARES = (0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5)
#: A word seen less often has no class of its own: broken-off words are such.
RARE = 5
#: Pseudo-texts by which a source's share of cuts is shrunk to that of its table.
SHRINK = 20.0
#: Bound of log odds of a single text.
MOST = 8.0


def scored(tabs: list[tuple[int, DataFrame, str]], least_limit: int = 40) -> DataFrame:
    """(tab, id, source, at_limit, posterior): the probability that a text is cut."""
    spark = tabs[0][1].sparkSession
    all_rows = measured(tabs)
    docs = all_rows.filter("kind = 0").drop("kind", "inner", "final")
    least = F.when(F.col("unit") == "words", F.lit(least_limit // 5)).otherwise(F.lit(least_limit))
    found = written(limits(docs)).filter(F.col("length") >= least)
    placed = docs.withColumn("s", F.coalesce("source", F.lit("")))
    for unit in UNITS:
        at = found.filter(F.col("unit") == unit).select(
            "tab", F.col("source").alias("s"), F.col("length").alias(unit), F.col("posterior").alias(f"at_{unit}")
        )
        placed = placed.join(at, ["tab", "s", unit], "left")
    words = all_rows.filter("kind = 1").groupBy("word")
    words = words.agg(F.sum("inner").alias("inner"), F.sum("final").alias("final"))
    share, seen = F.col("final") / F.col("inner"), F.when(F.coalesce("inner", F.lit(0)) < RARE, 0)
    seen = seen.when(F.col("final") == 0, 1)
    for i, bound in enumerate(SHARES):
        seen = seen.when(share < bound, i + 2)
    last = docs.select("word").distinct().join(words, "word", "left")
    last = last.select("word", seen.otherwise(len(SHARES) + 2).alias("seen"))
    worded = F.col("ends").isin(*PLAIN, CLOSED, FIELD)
    length_posterior = F.greatest(*(F.coalesce(f"at_{u}", F.lit(0.0)) for u in UNITS))
    placed = placed.join(last, "word", "left").select(
        "tab", "id", "source", "word", "pair", "content", length_posterior.alias("length_posterior"), "ends", "tail",
        "low", "stops", F.when(worded, F.col("seen")).otherwise(-1).alias("seen"),
    )
    placed = written(placed)
    placed = written(placed.transform(_signed))
    rest = F.sum(F.when(F.col("length_posterior") == 0, 1).otherwise(0)).alias("rest")
    counts = placed.groupBy("tab", "source", *CELL).agg(F.sum("length_posterior").alias("cut"), rest)
    counts = written(counts)
    cells = counts.groupBy("tab", *CELL).agg(F.sum("cut").alias("cut"), F.sum("rest").alias("rest")).toPandas()
    known = evidence(cells)
    kinds = ", ".join(f"{c} int" for c in CELL)
    kinds += ", at_ratio double, ratio double, share double, usual double"
    ratio = F.broadcast(spark.createDataFrame(known, f"tab int, {kinds}"))
    here = counts.join(ratio, ["tab", *CELL]).groupBy("tab", "source").applyInPandas(
        _by_source, f"tab int, source string, {', '.join(f'{c} int' for c in GROUP)}, here double, lift double"
    )
    here = here.withColumn("s", F.coalesce("source", F.lit(""))).drop("source")
    one = placed.withColumn("s", F.coalesce("source", F.lit(""))).join(ratio, ["tab", *CELL], "left")
    one = one.join(here, ["tab", "s", *GROUP], "left")
    at_limit = F.col("length_posterior") > 0
    share = F.coalesce("here", "share")
    prior = F.ln(F.col("length_posterior") / (1 - F.col("length_posterior")))
    odds = F.when(at_limit, prior + F.col("at_ratio") + F.coalesce("lift", F.lit(0.0)))
    odds = odds.otherwise(F.ln(share / (1 - share)) + F.col("ratio"))
    odds = F.greatest(F.least(odds, F.lit(MOST)), F.lit(-MOST))
    odds = F.when(F.col("ends").isin(MARKED, BROKEN_END), MOST).otherwise(odds)
    one = written(one.select("tab", "id", "source", "content", at_limit.alias("at_limit"), odds.alias("odds")))
    # Copies of which some look cut and some complete decide together.
    torn = one.groupBy("content").agg(F.avg("odds").alias("joint"), F.min("odds").alias("a"), F.max("odds").alias("b"))
    torn = written(torn.filter("a < 0 and b >= 0").select("content", "joint"))
    odds = F.coalesce("joint", "odds")
    return one.join(torn, "content", "left").select(
        "tab", "id", "source", "at_limit", (1 / (1 + F.exp(-odds))).alias("posterior")
    )


def mixed_share(ratio: np.ndarray, count: np.ndarray, prior: float, strength: float, rounds: int = 60) -> float:
    """The share of cut ones among ``count`` texts with likelihood ratios ``ratio``: EM with ``strength`` pseudo-texts."""
    share, total = max(prior, 0.02), count.sum() + strength
    for _ in range(rounds):
        cut = share * ratio / (share * ratio + 1 - share)
        share = float(np.clip(((cut * count).sum() + strength * prior) / max(total, 1e-9), 1e-6, 1 - 1e-6))
    return share


def _by_source(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source and each way to end: the share of cut texts among those off the limits (``here``), and how much
    more often than in the whole table the cut texts at limits end this way (``lift``, a log ratio)."""
    at, out = pdf["cut"].sum(), []
    for group, part in pdf.groupby(GROUP):
        ratio, count = np.exp(part["ratio"].to_numpy(float)), part["rest"].to_numpy(float)
        prior, usual = float(part["share"].iloc[0]), float(part["usual"].iloc[0])
        ends, low, stops, sign = group
        # Where the two kinds have no shapes of their own, and in texts without sentences, it is that of the table.
        own = ends in PLAIN and low != 1 and stops == 1 and sign == 0
        here = mixed_share(ratio, count, prior, SHRINK) if own else prior
        lift = math.log((part["cut"].sum() + SHRINK * usual) / (at + SHRINK) / usual)
        out.append([*key, *group, here, lift])
    return pd.DataFrame(out, columns=["tab", "source", *GROUP, "here", "lift"])


def _signed(placed: DataFrame) -> DataFrame:
    """``sign``: 1 where the last word, or the last two, end texts off the limits far more often than cuts explain."""
    off_limits = F.col("length_posterior") == 0
    sums = placed.agg(F.sum("length_posterior").alias("at"), F.sum(off_limits.cast("long")).alias("off")).first()
    at, off = sums["at"] or 0.0, sums["off"] or 0

    def often(cut: str, rest: str):
        return F.col(rest) > 5 * (0.05 * off * (F.col(cut) + 0.5) / (at + 50)) + 5

    how = ["ends", "stops"]
    # Copies count once.
    once = placed.filter(F.col("ends").isin(*PLAIN, FIELD)).groupBy("word", "pair", *how, "content")
    once = once.agg(F.max("length_posterior").alias("p")).groupBy("word", "pair", *how)
    pairs = once.agg(F.sum("p").alias("cut"), F.sum((F.col("p") == 0).cast("long")).alias("rest"))
    pairs = written(pairs.withColumn("pair_sign", often("cut", "rest").cast("int")))
    words = pairs.filter("pair_sign = 0").groupBy("word", *how)
    words = words.agg(F.sum("cut").alias("cut"), F.sum("rest").alias("rest")).filter(often("cut", "rest"))
    words = words.select("word", *how, F.lit(1).alias("word_sign"))
    signs = pairs.filter("pair_sign = 1").select("pair", *how, "pair_sign")
    placed = placed.join(signs, ["pair", *how], "left").join(words, ["word", *how], "left")
    sign = F.greatest(F.coalesce("pair_sign", F.lit(0)), F.coalesce("word_sign", F.lit(0))).alias("sign")
    return placed.select(*(c for c in placed.columns if c not in ("word", "pair", "pair_sign", "word_sign")), sign)


def evidence(cells: pd.DataFrame) -> pd.DataFrame:
    """For each cell of a table, from counts of texts at limits (``cut``, weighted) and off them (``rest``):

    ``at_ratio``, the log likelihood ratio of the cell, cut against complete; ``ratio``, that ratio within the
    texts that end alike; ``share``, the share of cut texts among those off the limits that end alike; and
    ``usual``, the share of the texts that end alike among the cut ones at limits.
    """
    cells = cells.copy()
    classes, tails = len(SHARES) + 3, 6
    closed = cells[cells["ends"] == CLOSED]
    final = np.bincount(closed["seen"].clip(0), closed["rest"], classes)[:classes] + 0.05
    tail = np.bincount(closed["tail"], closed["rest"], tails)[:tails] + 0.05
    final, tail = final / final.sum(), tail / tail.sum()
    plain = cells["ends"].isin(PLAIN) & (cells["low"] != 1) & (cells["sign"] == 0)
    # How cut texts end: by last word and length of the last sentence, from those at limits.
    shapes = {}
    for stops in (0, 1):
        part = cells[plain & (cells["stops"] == stops)]
        table = np.zeros((classes, tails))
        np.add.at(table, (part["seen"].to_numpy(), part["tail"].to_numpy()), part["cut"].to_numpy(float))
        word, size = table.sum(1) + 0.3, table.sum(0) + 0.3
        product = np.outer(word / word.sum(), size / size.sum())
        shape = (table + 20 * product) / (table.sum() + 20)
        shapes[stops] = shape if stops else shape.sum(1, keepdims=True) * np.ones((1, tails))
    out = []
    for tab, part in cells.groupby("tab"):
        part = part.assign(ratio=0.0, at_ratio=0.0, share=1e-4)
        at, off = part["cut"].sum(), part["rest"].sum()
        whole = np.zeros(len(part))
        mine = plain.loc[part.index].to_numpy()
        seen, size, stops = (part[c].to_numpy() for c in ("seen", "tail", "stops"))
        each = list(zip(mine, stops, seen, size))
        cut_shape = np.array([shapes[s][k, t] if m else 1.0 for m, s, k, t in each])
        whole_shape = np.array([final[k] * (tail[t] if s else 1.0) if m else 1.0 for m, s, k, t in each])
        ratio = cut_shape / whole_shape
        share, cut_p = np.full(len(part), 1e-4), np.zeros(len(part))
        rest, cut = part["rest"].to_numpy(float), part["cut"].to_numpy(float)
        groups = [np.asarray(rows) for rows in part.reset_index().groupby(GROUP).groups.values()]
        for rows in groups:
            if mine[rows[0]] and stops[rows[0]]:
                share[rows] = mixed_share(ratio[rows], rest[rows], 0.05, 2.0)
        # How often texts off the limits are cut; whether they have sentences or not makes no difference.
        spoken = part["stops"].to_numpy() == 0
        base = float(np.clip((share * rest)[mine & ~spoken].sum() / max(rest[~spoken].sum(), 1), 1e-4, 0.5))
        share[mine & spoken] = base
        usual = np.zeros(len(part))
        for rows in groups:
            n, c = rest[rows].sum(), cut[rows].sum()
            usual[rows] = (c + 0.02) / (at + 1)
            if mine[rows[0]]:
                whole[rows] = (n * (1 - share[rows]) + 0.02) / (off + 1) * whole_shape[rows]
                cut_p[rows] = usual[rows] * cut_shape[rows]
            else:
                whole[rows] = (rest[rows] + 0.02 * (n + 1) / len(rows)) / (off + 1)
                cut_p[rows] = (cut[rows] + 0.02 * (c + 1) / len(rows)) / (at + 1)
                # Of texts that end in other ways, cuts are as frequent as at limits.
                odds = base / (1 - base) * usual[rows[0]] / ((n + 0.02) / (off + 1))
                share[rows] = min(odds / (1 + odds), 0.4)
        part["ratio"] = np.where(mine, np.log(ratio), 0.0)
        part["at_ratio"] = np.log(cut_p / whole)
        part["share"], part["usual"] = np.clip(share, 1e-6, 1 - 1e-6), usual
        out.append(part)
    known = pd.concat(out) if out else cells.assign(at_ratio=0.0, ratio=0.0, share=0.0, usual=0.0)
    columns = ["tab", *CELL, "at_ratio", "ratio", "share", "usual"]
    return known[columns].astype({c: "int32" for c in ["tab", *CELL]} | {c: "float64" for c in columns[-4:]})


def cut_records(tabs: list[tuple[int, DataFrame, str]], threshold: float = 0.5) -> DataFrame:
    return scored(tabs).filter(F.col("posterior") >= threshold).select("tab", "id").distinct()


def cut_rates(tabs: list[tuple[int, DataFrame, str]], threshold: float = 0.5) -> DataFrame:
    """How often each source's texts are cut: (tab, source, texts, cut, share, at_limit)."""
    hit = F.col("posterior") >= threshold
    return scored(tabs).groupBy("tab", "source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(hit.cast("long")).alias("cut"),
        F.avg(hit.cast("double")).alias("share"),
        F.sum((hit & F.col("at_limit")).cast("long")).alias("at_limit"),
    )
