"""Rewrites that make machine text look human: a test of robustness.

Where the definition draws at random, a hash of the text or place decides, so results repeat and do not depend on
partitions: a rewrite with rate r is done where the hash falls into the first r of its range. Null texts stay null.
"""

from __future__ import annotations

import re
from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import wordlists as L

# The rates of the definition.
SWAP_RATE, SPLIT_RATE, JOIN_RATE = 0.3, 0.4, 0.3
SEMICOLON_RATE, EXCLAMATION_RATE, QUESTION_RATE, PRONOUN_RATE = 0.2, 0.1, 0.15, 0.15
LONG_SENTENCE, SHORT_SENTENCE = 25, 8


def _gate(key: Column, rate: float) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") < int(65536 * rate)


def _falls(key: str, rate: float) -> bool:
    """The same decision in Python."""
    return int(md5(key.encode("utf-8", "replace")).hexdigest()[:4], 16) < int(65536 * rate)


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _capital(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2_000_000_000))


def without_connectors(text: Column | str) -> Column:
    """Connectors that open a sentence are dropped, with the commas and blanks after them; the next letter is a capital."""
    opener = "(?i)^(?:" + "|".join(sorted(L.CONNECTORS, key=len, reverse=True)) + ")[ ,]+"

    def bare(s: Column) -> Column:
        cut = F.regexp_replace(s, opener, "")
        return F.when(cut == s, s).otherwise(_capital(X.strip(cut)))

    return F.array_join(F.transform(X.stop_sentences(text), bare), " ")


def swapped(text: Column | str, rate: float = SWAP_RATE) -> Column:
    """Listed words give way to their synonyms, trailing punctuation lost as the definition has it; a capital stays one.

    A hash of word and place decides below rate 1.
    """
    table = F.create_map(*[F.lit(x) for kv in L.SYNONYMS.items() for x in kv])

    def swap(w: Column, i: Column) -> Column:
        new = F.try_element_at(table, F.regexp_replace(F.lower(w), r"^[.,;:!?]+|[.,;:!?]+$", ""))
        new = F.when(F.substring(w, 1, 1).rlike(r"\p{Lu}"), _capital(new)).otherwise(new)
        return F.coalesce(new if rate >= 1 else F.when(_gate(F.concat(w, F.lit("-"), i.cast("string")), rate), new), w)

    return F.array_join(F.transform(X.space_words(text), swap), " ")


def repunctuated(
    text: Column | str, semicolon: float = SEMICOLON_RATE, exclamation: float = EXCLAMATION_RATE,
    question: float = QUESTION_RATE,
) -> Column:
    """Commas become semicolons, full stops exclamation marks, the first full stop left a question mark: each where a
    hash of the whole text says so."""
    t = _c(text)
    gate = lambda name, rate: _gate(F.concat(F.lit(f"{name}-"), t), rate)
    out = F.when(gate("c", semicolon), F.replace(t, F.lit(", "), F.lit("; "))).otherwise(t)
    out = F.when(gate("e", exclamation), F.replace(out, F.lit(". "), F.lit("! "))).otherwise(out)
    return F.when(gate("q", question), F.regexp_replace(out, r"(?s)^(.*?)\. ", "$1? ")).otherwise(out)


def in_first_person(text: Column | str, rate: float = PRONOUN_RATE) -> Column:
    """In sentences of more than three words the word I is put at the fourth place, where a hash of sentence and place
    says so."""

    def put(s: Column, i: Column) -> Column:
        words = X.space_words(s)
        new = F.array_join(F.array_insert(words, 4, F.lit("I")), " ")
        chosen = F.size(words) > 3
        if rate < 1:
            chosen = chosen & _gate(F.concat(s, F.lit("-"), i.cast("string")), rate)
        return F.when(chosen, new).otherwise(s)

    return F.array_join(F.transform(X.stop_sentences(text), put), " ")


def _halves(sentence: str, rate: float) -> list[str]:
    """A long sentence cut in the middle; of the word at the cut only the first letter is left, as a capital."""
    words = sentence.split()
    if len(words) <= LONG_SENTENCE or not _falls(f"s-{sentence}", rate):
        return [sentence]
    head, middle, tail = words[: len(words) // 2], words[len(words) // 2], words[len(words) // 2 + 1 :]
    return [f"{' '.join(head).rstrip(',;:')}.", middle[0].upper() + " ".join(tail)]


def vary(text: str | None, split: float = SPLIT_RATE, join: float = JOIN_RATE) -> str | None:
    """Long sentences (over 25 words) are cut in the middle; pairs of neighbours of fewer than 8 words become one."""
    if text is None:
        return None
    out: list[str] = []
    alone = False
    for piece in (half for s in re.split(r"(?<=[.!?])\s+", text) for half in _halves(s, split)):
        short = len(piece.split()) < SHORT_SENTENCE
        if alone and short and len(out[-1].split()) < SHORT_SENTENCE and _falls(f"m-{out[-1]}-{piece}", join):
            out[-1] = f"{out[-1].rstrip('.!?')}, and {piece.lower()}"
            alone = False
        else:
            out.append(piece)
            alone = True
    return " ".join(out)


def varied(text: Column | str, split: float = SPLIT_RATE, join: float = JOIN_RATE) -> Column:
    return F.pandas_udf(lambda t: t.map(lambda x: vary(x, split, join)), "string")(_c(text))


STRATEGIES = {
    "remove_connectors": without_connectors,
    "synonym_swap": swapped,
    "vary_sentence_length": varied,
    "randomize_punctuation": repunctuated,
    "add_first_person": in_first_person,
}


def humanized(text: Column | str, strategy: str = "combined") -> Column:
    """One of the strategies, or all in turn; an unknown name is an error."""
    if strategy == "combined":
        for step in STRATEGIES.values():
            text = step(text)
        return text
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)} or combined")
    return STRATEGIES[strategy](text)


__all__ = ["STRATEGIES", "humanized", "in_first_person", "repunctuated", "swapped", "varied", "vary", "without_connectors"]
