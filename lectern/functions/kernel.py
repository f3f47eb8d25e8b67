"""All style features of a text in one Arrow pass.

Texts of a batch are tokenised once; each distinct word is looked at once by a worker and gets a number, a set of
flags (the lists and endings it belongs to) and its syllables. Everything that is a count of words, sentences,
trigrams or distinct words then comes from sorted arrays of such numbers over a whole batch, and no word is touched
twice. Four profiles share this: ``serve``, ``v0``, ``train`` and ``adversarial`` name the same features but differ
in tokens, lists, least sizes and deviations.

Defined results: a null or too short text has null features; a text of any length is one row; densities are counts
by thousand words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import wordlists as L

ORIGINAL = [
    "mtld", "sent_cv", "self_mention_density", "opener_ratio", "connector_density", "hedge_density", "mean_sent_len",
    "boost_density", "char_entropy", "rep_rate", "punct_entropy",
]
EXTENDED = [
    "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index", "positive_density",
    "negative_density", "sentiment_polarity", "exclamation_density", "question_density", "passive_density",
    "subordination_density", "preposition_density", "adjective_density", "adverb_density", "nominalization_density",
    "capitalized_entity_density", "number_density", "acronym_density", "url_email_density", "quote_density",
    "type_token_ratio", "hapax_legomena_ratio", "yules_k", "simpsons_d", "noun_verb_ratio", "adj_adv_ratio",
    "pos_transition_entropy", "sent_length_std",
]
ALL = ORIGINAL + EXTENDED
#: Features that need no word list of a language.
AGNOSTIC = [
    "char_entropy", "punct_entropy", "rep_rate", "mean_sent_len", "sent_cv", "sent_length_std", "type_token_ratio",
    "hapax_legomena_ratio", "yules_k", "simpsons_d", "exclamation_density", "question_density", "number_density",
    "quote_density",
]
#: Without a part-of-speech tagger these three have fixed values.
UNTAGGED = {"noun_verb_ratio": 1.5, "adj_adv_ratio": 1.0, "pos_transition_entropy": 0.0}

CJK = re.compile("[぀-ヿ一-鿿]")
STRICT = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(])")
LOOSE = re.compile(r"[.!?]+(?:\s|$)|\n+")
GAP = re.compile(r"\s+")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
NUMBER = re.compile(r"\b\d+(?:\.\d+)?\b")
ACRONYM = re.compile(r"\b[A-Z]{2,}s?\b")
ENTITY = re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b")
LINK = re.compile(r"https?://\S+|\b[\w.+-]+@[\w-]+\.[\w.-]+\b")
PASSIVE = re.compile(
    rf"\b(?:{'|'.join(L.PASSIVE_AUXILIARIES)})\s+(?:\w+ed|{'|'.join(L.PASSIVE_PARTICIPLES)})\b", re.IGNORECASE
)

KINDS = ("hedge", "booster", "connector", "self_mention")
LETTER, CONTENT, COMPLEX, POSITIVE, NEGATIVE, SUBORDINATE, PREPOSITION, ADJECTIVE, ADVERB, NOMINAL = (
    1 << i for i in range(10)
)
#: Words a worker keeps; beyond that it starts anew.
KEPT_WORDS = 400_000
#: Characters worked off at a time.
PASS_CHARS = 1 << 18


@dataclass(frozen=True)
class Profile:
    token: re.Pattern
    lower_first: bool
    sentence: re.Pattern
    lists: tuple[tuple[str, tuple[str, ...]], ...]
    phrases: tuple[str, ...]
    stopwords: frozenset[str]
    least_content: int
    least_words: int
    least_chars: int
    least_sentences: int
    ddof: int
    keep_wordless: bool
    opener: str
    types_repeated: bool
    flat_trigrams: bool
    punctuation: str
    mtld: str


def _lists(hedges: list[str], boosters: list[str], connectors: list[str], selves: list[str]) -> tuple:
    return tuple(zip(KINDS, map(tuple, (hedges, boosters, connectors, selves))))


@cache
def profile(name: str) -> Profile:
    ascii_word, own = re.compile(r"\b[a-zA-Z]+\b"), _lists(L.HEDGES, L.BOOSTERS, L.CONNECTORS, L.SELF_MENTIONS)
    stop, phrases = frozenset(L.STOPWORDS), tuple(L.HEDGE_PHRASES)
    if name == "serve":
        return Profile(
            re.compile(r"\w+"), True, STRICT, own, phrases, stop, 3, 5, 0, 1, 1, False, "prefix", False, True,
            L.PUNCTUATION, "zero",
        )
    if name == "v0":
        return Profile(
            ascii_word, True, STRICT, own, phrases, stop, 3, 20, 0, 1, 1, False, "prefix", False, True, L.PUNCTUATION,
            "null",
        )
    if name == "train":
        lists = _lists(L.TRAIN_HEDGES, L.BOOSTERS, L.TRAIN_CONNECTORS, L.SELF_MENTIONS)
        return Profile(
            ascii_word, True, STRICT, lists, (), frozenset(L.TRAIN_STOPWORDS), 3, 50, 30, 1, 1, False, "spaced", False,
            True, L.PUNCTUATION + "`", "null",
        )
    if name == "adversarial":
        lists = _lists(L.ADVERSARIAL_HEDGES, L.ADVERSARIAL_BOOSTERS, L.ADVERSARIAL_CONNECTORS, L.ADVERSARIAL_SELVES)
        return Profile(
            re.compile(r"[a-zA-Z]+(?:'[a-z]+)?"), False, LOOSE, lists, (), frozenset(L.ADVERSARIAL_STOPWORDS), 0, 10,
            50, 2, 0, True, "first", True, False, L.PUNCTUATION.replace("{", "").replace("}", ""), "total",
        )
    raise ValueError(f"unknown profile {name!r}; one of serve, v0, train, adversarial")


_SILENT = re.compile(r"(?:[^aeiouy]es|ed|[^aeiouy]e)$")
_VOWELS = re.compile(r"[aeiouy]+")


def syllables(word: str) -> int:
    """Vowel groups after a silent ending is taken off; 1 for words of up to three letters."""
    if len(word) <= 3:
        return 1
    bare = _SILENT.sub("", word)
    return max(1, len(_VOWELS.findall(bare[1:] if bare[:1] == "y" else bare)))


class Lexicon(dict):
    """Words to numbers; ``flags`` and ``syllables`` by number."""

    def __init__(self, p: Profile):
        self.p = p
        self.languages = ["", *L.LANGUAGES] if p.token.pattern == r"\w+" else [""]
        self.clear_all()
        single = lambda words: frozenset(w for w in words if re.fullmatch(r"\w+", w))
        # Hedges, boosters and self-mentions are compared as they stand; connectors are looked for in the text.
        self.sets = []
        for i, lang in enumerate(self.languages):
            lists = L.LANGUAGES[lang] if lang else dict(p.lists)
            self.sets += [(1 << (10 + 4 * i + k), frozenset(lists[kind]) if kind != "connector" else single(lists[kind]))
                          for k, kind in enumerate(KINDS)]
        self.sets += [
            (POSITIVE, frozenset(L.POSITIVES)), (NEGATIVE, frozenset(L.NEGATIVES)),
            (SUBORDINATE, frozenset(L.SUBORDINATORS)), (PREPOSITION, frozenset(L.PREPOSITIONS)),
        ]
        self.endings = [
            (ADJECTIVE, tuple(L.ADJECTIVE_SUFFIXES), 5), (ADVERB, ("ly",), 4), (NOMINAL, tuple(L.NOMINALIZATION_SUFFIXES), 6),
        ]

    def clear_all(self) -> None:
        self.clear()
        self.flags, self.syllables = [], []

    def __missing__(self, word: str) -> int:
        low = word if self.p.lower_first else word.lower()
        flags = LETTER if any(map(str.isalpha, low)) else 0
        n = syllables(low)
        if len(low) >= self.p.least_content and low not in self.p.stopwords:
            flags |= CONTENT
        if n >= 3:
            flags |= COMPLEX
        for flag, words in self.sets:
            if low in words:
                flags |= flag
        for flag, suffixes, least in self.endings:
            if len(low) >= least and low.endswith(suffixes):
                flags |= flag
        if low != word:
            self[word] = number = self[low]
            return number
        self[word] = number = len(self.flags)
        self.flags.append(flags)
        self.syllables.append(n)
        return number


_lexicons: dict[str, Lexicon] = {}


@cache
def _phrase_pattern(phrases: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, phrases), key=len, reverse=True))})\b")


def _phrases(low: str, phrases: tuple[str, ...]) -> int:
    return len(_phrase_pattern(phrases).findall(low)) if phrases and any(x in low for x in phrases) else 0


@cache
def _several(name: str, lang: str) -> tuple[str, ...]:
    """Connectors of more than one word, where the profile looks for them in the text."""
    words = L.LANGUAGES[lang]["connector"] if lang else dict(profile(name).lists)["connector"]
    return tuple(w for w in words if not re.fullmatch(r"\w+", w)) if name in ("serve", "v0") else ()


@cache
def _opener(name: str, lang: str) -> re.Pattern:
    words = L.LANGUAGES[lang]["connector"] if lang else dict(profile(name).lists)["connector"]
    after = {"prefix": "[ ,]", "spaced": r"[\s,]", "first": r"(?!'?[a-z])"}[profile(name).opener]
    return re.compile(f"(?:{'|'.join(sorted(map(re.escape, words), key=len, reverse=True))}){after}")


def language(text: str, sample: int = 500) -> str:
    """Language by script and function words of the first ``sample`` characters, as the definition has it; "" if unknown."""
    head = text[:sample]
    if len(re.findall("[一-鿿]", head)) > 0.1 * len(head):
        return "zh"
    low = head.lower()
    scores = {lang: sum(map(low.count, marks)) for lang, marks in L.LANGUAGE_MARKERS.items()}
    best = max(scores, key=scores.get)
    return best if scores[best] and best != "en" else ""


def lengths_between(numbers: list[int], threshold: float = 0.72) -> float:
    """Factors of lexical diversity in a sequence: it ends where the share of distinct words falls to the threshold."""
    factors, seen, n = 0.0, set(), 0
    add = seen.add
    for x in numbers:
        add(x)
        n += 1
        if len(seen) <= threshold * n and len(seen) / n <= threshold:
            factors += 1
            seen.clear()
            n = 0
    return factors + ((1 - len(seen) / n) / (1 - threshold) if n else 0.0)


def diversity(numbers: list[int], how: str, least: int = 10) -> float | None:
    """Words by factor, both ways: the mean of the two, or for ``total`` words by the mean of factors."""
    n = len(numbers)
    if n < least:
        return 0.0 if how == "zero" else None
    a, b = lengths_between(numbers), lengths_between(numbers[::-1])
    if how == "total":
        return n / ((a + b) / 2) if a + b else 0.0
    return ((n / a if a else n) + (n / b if b else n)) / 2


def sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return c[bound[1:]] - c[bound[:-1]]


def entropy(total: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """log2(N) - sum(c log2 c) / N; 0 for none."""
    n = np.maximum(total, 1)
    return np.where(total > 0, np.log2(n) - weighted / n, 0.0)


def counts_of(owner: np.ndarray, value: np.ndarray, texts: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's distinct values: how often each occurs, and where the text's counts start (one entry more)."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(bits)) | value.astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]]))
    return count, np.searchsorted(key[first] >> np.uint64(bits), np.arange(texts + 1, dtype=np.uint64))


def measure(texts: list[str | None], name: str = "serve", lang: str | None = "en", compose: bool = False) -> dict:
    """Arrays of all features of the texts, ``n_words``, ``n_sents`` and ``enough`` (False: features are null).

    ``lang``: the language whose lists count; None: found text by text. ``compose``: texts in NFKC.
    """
    p = profile(name)
    lex = _lexicons.get(name)
    if lex is None or len(lex) > KEPT_WORDS:
        lex = _lexicons[name] = Lexicon(p)
    size, bullets = len(texts), np.zeros((len(texts), len(p.punctuation)))
    tokens: list[str] = []
    sent_tokens, sent_first, text_first = [], [0], [0]
    flat: list[str] = []
    # Openers, hedge phrases, connectors, passives, entities, numbers, acronyms, links, quotes, characters.
    seen = np.zeros((size, 10))
    langs: list[str] = []
    single_words: dict[int, list[str]] = {}
    for i, text in enumerate(texts):
        if text is None:
            sent_first.append(len(sent_tokens))
            text_first.append(len(tokens))
            flat.append("")
            langs.append("")
            continue
        if compose:
            text = unicodedata.normalize("NFKC", text)
        low = text.lower()
        found = language(text) if lang is None else "" if lang in ("en", "unknown") else lang
        found = found if found in L.LANGUAGES and name == "serve" else ""
        langs.append(found)
        parts = [s for s in map(str.strip, p.sentence.split(text.strip())) if s] or [text.strip()]
        opens = _opener(name, found).match
        cjk = name == "serve" and CJK.search(low) is not None
        for s in parts:
            s_low = s.lower()
            words = p.token.findall(s_low if p.lower_first else s)
            if cjk and len(CJK.findall(s_low)) > 0.1 * len(s_low):
                words = [c for c in s_low if CJK.match(c) or c.isalpha()]
            sent_tokens.append(len(words))
            tokens += words
            if p.opener == "first":
                seen[i, 0] += bool(words) and lex.flags[lex[words[0]]] >> (10 + 2) & 1
            elif opens(s_low):
                seen[i, 0] += 1
        if cjk and len(CJK.findall(low)) > 0.1 * len(low):
            single_words[i] = [c for c in low if CJK.match(c) or c.isalpha()]
        elif cjk:
            single_words[i] = p.token.findall(low)
        sent_first.append(len(sent_tokens))
        text_first.append(len(tokens))
        row = seen[i]
        row[1] = _phrases(low, p.phrases)
        row[2] = _phrases(low, _several(name, found))
        if cjk:
            bit = 10 + 4 * lex.languages.index(found) + KINDS.index("connector")
            row[2] += sum(lex.flags[lex[w]] >> bit & 1 for w in re.findall(r"\w+", low))
        row[3], row[4], row[5] = len(PASSIVE.findall(text)), len(ENTITY.findall(text)), len(NUMBER.findall(text))
        row[6], row[8] = len(ACRONYM.findall(text)), len(QUOTED.findall(text))
        row[7] = len(LINK.findall(text)) if "http" in text or "@" in text else 0
        row[9] = len(text.strip()) if name == "adversarial" else len(text)
        for k, c in enumerate(p.punctuation):
            bullets[i, k] = text.count(c)
        flat.append(GAP.sub(" ", low) if p.flat_trigrams else text)
    number = np.fromiter(map(lex.__getitem__, tokens), np.int64, len(tokens))
    flags, syllable = np.array(lex.flags, np.int64), np.array(lex.syllables, np.int64)
    # Runs of word characters without a letter are no words; single characters of a CJK text all are.
    worded = flags[number] & LETTER > 0 if len(number) else np.zeros(0, bool)
    sent_of = np.repeat(np.arange(len(sent_tokens)), sent_tokens)
    counted = np.bincount(sent_of[worded], minlength=len(sent_tokens)).astype(float)
    sent_first, text_first = np.array(sent_first), np.array(text_first)
    kept = np.flatnonzero(worded)
    bound = np.searchsorted(kept, text_first)
    number = number[kept]
    if single_words:  # words of a CJK text as a whole, which differ from those of its sentences
        parts = [number[a:b] for a, b in zip(bound[:-1], bound[1:])]
        for i, words in single_words.items():
            ids = np.array([lex[w] for w in words], np.int64)
            flags, syllable = np.array(lex.flags, np.int64), np.array(lex.syllables, np.int64)
            parts[i] = ids[flags[ids] & LETTER > 0] if len(ids) else ids
        number = np.concatenate(parts) if parts else number
        bound = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    n = np.diff(bound).astype(float)
    owner = np.repeat(np.arange(size), np.diff(bound))
    own = flags[number] if len(number) else np.zeros(0, np.int64)
    has = lambda flag: sums(own & flag > 0, bound)
    listed = {}
    place = np.array([lex.languages.index(x) for x in langs] or [0])
    for k, kind in enumerate(KINDS):
        bit = (10 + 4 * place + k)[owner] if len(owner) else np.zeros(0, np.int64)
        listed[kind] = sums((own >> bit) & 1, bound)
    # Sentence lengths; those without a word are left out where the profile says so.
    used = np.ones(len(counted), bool) if p.keep_wordless else counted > 0
    place_of = np.concatenate([[0], np.cumsum(used)])[sent_first]
    lens = counted[used]
    sents, k = np.diff(sent_first).astype(float), np.diff(place_of).astype(float)
    mean = sums(lens, place_of) / np.maximum(k, 1)
    square = sums((lens - np.repeat(mean, np.diff(place_of))) ** 2, place_of)
    deviation = np.where(k >= (2 if p.ddof else 1), np.sqrt(square / np.maximum(k - p.ddof, 1)), 0.0)
    per = np.maximum(n / 1000.0, 0.001)
    # Distinct words.
    is_content = own & CONTENT > 0
    times, at = counts_of(owner[is_content], number[is_content], size, 32)
    m, types = sums(times, at), np.diff(at).astype(float)
    again, once, squares = sums(np.where(times > 1, times, 0), at), sums(times == 1, at), sums(times * times, at)
    if p.types_repeated:
        again, whole = sums(times > 1, at), types
    else:
        whole = m
    # Trigrams.
    code = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])])
    grams = np.maximum(np.diff(ends) - 2, 0)
    begin = np.repeat(ends[:-1] - np.concatenate([[0], np.cumsum(grams)])[:-1], grams) + np.arange(grams.sum())
    mixed = (code[begin] * np.uint64(0x9E3779B97F4A7C15) + code[begin + 1]) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed + code[begin + 2]) * np.uint64(0xC2B2AE3D27D4EB4F) if len(begin) else np.zeros(0, np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)
    gram_times, gram_at = counts_of(np.repeat(np.arange(size), grams), mixed, size, 44)
    points = bullets.sum(1)
    marks = {c: bullets[:, p.punctuation.index(c)] for c in "!?"}
    words = number.tolist()
    mtld = [diversity(words[a:b], p.mtld) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
    full = np.maximum(sents, 1)
    wps, spw, hard = n / full, sums(syllable[number], bound) / np.maximum(n, 1), has(COMPLEX)
    good, bad = has(POSITIVE), has(NEGATIVE)
    enough = (n >= p.least_words) & (sents >= p.least_sentences) & (seen[:, 9] >= p.least_chars) & (k > 0)
    enough &= np.array([bool(t) for t in texts])
    out = {
        "mtld": np.array([np.nan if v is None else v for v in mtld]),
        "sent_cv": np.where(mean > 0, deviation / np.maximum(mean, 1e-300), 0.0),
        "self_mention_density": listed["self_mention"] / per,
        "opener_ratio": seen[:, 0] / full,
        "connector_density": (listed["connector"] + seen[:, 2]) / per,
        "hedge_density": (listed["hedge"] + seen[:, 1]) / per,
        "mean_sent_len": mean,
        "boost_density": listed["booster"] / per,
        "char_entropy": entropy(grams, sums(gram_times * np.log2(gram_times), gram_at)),
        "rep_rate": np.where(whole > 0, again / np.maximum(whole, 1), 0.0),
        "punct_entropy": entropy(points, (bullets * np.log2(np.maximum(bullets, 1))).sum(1)),
        "flesch_reading_ease": 206.835 - 1.015 * wps - 84.6 * spw,
        "flesch_kincaid_grade": 0.39 * wps + 11.8 * spw - 15.59,
        "gunning_fog": 0.4 * (wps + 100.0 * (hard / np.maximum(n, 1))),
        "smog_index": 1.043 * np.sqrt(hard * (30.0 / full)) + 3.1291,
        "positive_density": good / per,
        "negative_density": bad / per,
        "sentiment_polarity": (good - bad) / np.maximum(good + bad, 1),
        "exclamation_density": marks["!"] / per,
        "question_density": marks["?"] / per,
        "passive_density": seen[:, 3] / per,
        "subordination_density": has(SUBORDINATE) / per,
        "preposition_density": has(PREPOSITION) / per,
        "adjective_density": has(ADJECTIVE) / per,
        "adverb_density": has(ADVERB) / per,
        "nominalization_density": has(NOMINAL) / per,
        "capitalized_entity_density": seen[:, 4] / per,
        "number_density": seen[:, 5] / per,
        "acronym_density": seen[:, 6] / per,
        "url_email_density": seen[:, 7] / per,
        "quote_density": seen[:, 8] / per,
        "type_token_ratio": np.where(m > 0, types / np.maximum(m, 1), 0.0),
        "hapax_legomena_ratio": np.where(m > 0, once / np.maximum(m, 1), 0.0),
        "yules_k": np.where(m > 0, 10000 * (squares - m) / np.maximum(m * m, 1), 0.0),
        "simpsons_d": np.where(m > 1, 1 - squares / np.maximum(m * m, 1), 0.0),
        **{f: np.full(size, v) for f, v in UNTAGGED.items()},
        "sent_length_std": np.where(k >= 2, np.sqrt(square / np.maximum(k - 1, 1)), 0.0),
    }
    return out | {"n_words": n, "n_sents": sents, "enough": enough}


def _passes(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= PASS_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def features(
    text: Column | str, name: str = "serve", columns: list[str] | None = None, lang: str | None = "en",
    compose: bool = False,
) -> Column:
    """A struct of the named features (all of the profile by default), ``n_words`` and ``n_sents``."""
    wanted = columns if columns is not None else (ALL if name == "serve" else ORIGINAL)
    counts = ["n_words", "n_sents"]
    fields = [pa.field(c, pa.float64()) for c in wanted] + [pa.field(c, pa.int64()) for c in counts]
    kind = f"struct<{','.join([*(f'{c}:double' for c in wanted), *(f'{c}:bigint' for c in counts)])}>"

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            texts = column.to_pylist()
            each = [measure(x, name, lang, compose) for x in _passes(texts)]
            names = [*wanted, *counts, "enough"]
            joined = {c: np.concatenate([e[c] for e in each]) if each else np.zeros(0) for c in names}
            null, absent = ~joined["enough"].astype(bool), np.array([t is None for t in texts], bool)
            arrays = [pa.array(joined[c], mask=null | np.isnan(joined[c])) for c in wanted]
            arrays += [pa.array(joined[c].astype(np.int64), mask=absent) for c in counts]
            yield pa.StructArray.from_arrays(arrays, fields=fields)

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER)(F.col(text) if isinstance(text, str) else text)


def with_features(df: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """``df`` with the features as columns. Columns of ``df`` that have a feature's name are replaced."""
    f = df.withColumn("_f", features(text_col, **settings))
    names = [x.name for x in f.schema["_f"].dataType.fields]
    return f.select(*(c for c in df.columns if c not in names), *(F.col(f"_f.{c}").alias(c) for c in names))


def vector(df: DataFrame, columns: list[str] | None = None, text_col: str = "text", **settings) -> DataFrame:
    """``df`` with ``vector``: the named features in that order, 0.0 for names that are no feature; null if too short."""
    wanted = columns if columns is not None else ALL
    real = [c for c in wanted if c in ALL]
    f = df.withColumn("_f", features(text_col, columns=real, **settings))
    parts = [F.col(f"_f.{c}") if c in ALL else F.lit(0.0) for c in wanted]
    short = F.col(f"_f.{real[0]}").isNull() if real else F.lit(False)
    return f.withColumn("vector", F.when(~short, F.array(*parts))).drop("_f")
