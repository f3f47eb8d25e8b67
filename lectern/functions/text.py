"""Native column builders for text: tokenisers, counts, truncation, chunks, language, normalisers.

All are built-in expressions. Null texts give null. Regular expressions name Unicode classes where the
definition is Unicode-aware, because Java's ``\\s``, ``\\w`` and ``\\b`` are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import wordlists as L

#: White space as Unicode has it; Java's \s alone is ASCII.
SPACE = r"[\s\x0b\p{Z}\x{85}\x{1c}-\x{1f}]"
WORD = r"[\p{L}\p{N}_]+"
#: A word that holds a letter.
LETTERED = r"[\p{N}_]*\p{L}[\p{L}\p{N}_]*"
CJK = r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(text: Column | str) -> Column:
    """Split after . ! ? before a capital letter, quote or bracket; the whole text if nothing is left."""
    found = _filled(F.split(strip(text), rf"(?<=[.!?]){SPACE}+(?=[A-Z\"'(])"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(_c(text)))


def sentence_offsets(text: Column | str) -> Column:
    """Sentences with start and end in characters: runs up to and with their stops, closing quotes and space; those without a word are dropped after positions are counted."""
    parts = F.regexp_extract_all(_c(text), F.lit(r"[^.!?]*[.!?]+[\"'\s]*|[^.!?]+$"), F.lit(0))
    step = lambda acc, s: F.struct(
        (acc["at"] + F.length(s)).alias("at"),
        F.concat(acc["out"], F.array(F.struct(strip(s).alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(s)).alias("end"), s.rlike(r"[\p{L}\p{N}_]").alias("worded")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int,worded:boolean>>").alias("out"))
    all_parts = F.aggregate(parts, start, step)["out"]
    return F.transform(F.filter(all_parts, lambda s: s["worded"]), lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))


def paragraph_sentences(text: Column | str) -> Column:
    """Sentences within paragraphs: blank lines part paragraphs, single breaks are spaces."""
    marked = F.regexp_replace(F.regexp_replace(_c(text), r"\n{2,}", " <PARA> "), r"\n", " ")
    pieces = F.flatten(F.transform(F.split(marked, r"(?<=[.!?])\s+(?=[A-Z])"), lambda p: F.split(p, "<PARA>")))
    return _filled(pieces)


def loose_sentences(text: Column | str) -> Column:
    """Split at stops before space or the end, and at line breaks; stops are dropped."""
    return _filled(F.split(_c(text), r"[.!?]+(?:\s|$)|\n+"))


def stop_sentences(text: Column | str) -> Column:
    """Split at the space after . ! ?"""
    return F.split(_c(text), r"(?<=[.!?])\s+")


def stop_count(text: Column | str) -> Column:
    """Number of . ! ?, at least 1."""
    t = _c(text)
    return F.greatest(F.lit(1), F.length(t) - F.length(F.translate(t, ".?!", "")))


def words(text: Column | str) -> Column:
    """Lower-case words that hold a letter; single characters where more than a tenth of the text is CJK or kana."""
    low = F.lower(_c(text))
    plain = F.regexp_extract_all(low, F.lit(LETTERED), F.lit(0))
    single = F.filter(F.split(low, ""), lambda c: c.rlike(r"[\p{L}\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"))
    return F.when(F.regexp_count(_c(text), F.lit(CJK)) > F.length(_c(text)) * 0.1, single).otherwise(plain)


def word_count(text: Column) -> Column:
    """The number of ``words``, without making them."""
    return F.when(text.rlike(CJK), F.size(words(text))).otherwise(F.regexp_count(text, F.lit(LETTERED)))


def ascii_words(text: Column | str) -> Column:
    """Lower-case runs of a-z that no other word character touches."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]+(?![\p{L}\p{N}_])"), F.lit(0))


def apostrophe_words(text: Column | str) -> Column:
    """Runs of ASCII letters with an optional ending after an apostrophe, lower-cased afterwards."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"[a-zA-Z]+(?:'[a-z]+)?"), F.lit(0)), F.lower)


def tokens(text: Column | str) -> Column:
    """Lower-case words, numbers kept."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0))


def space_words(text: Column | str) -> Column:
    """Words parted by white space."""
    return F.filter(F.split(_c(text), SPACE + "+"), lambda w: w != "")


def syllable_counts(spaced: Column) -> tuple[Column, Column]:
    """Of words parted and framed by single blanks: all syllables, and the words of three or more; the same counts as ``syllables`` word by word, in passes over the whole string."""
    short = F.regexp_replace(spaced, r"(?<= )[^ ]{1,3}(?= )", "a")
    bare = F.regexp_replace(F.regexp_replace(short, r"(?:[^aeiouy ]es|ed|[^aeiouy ]e)(?= )", ""), r"(?<= )y(?=[^ ])|(?<= )y(?= )", "")
    silent = F.regexp_count(bare, F.lit(r"(?<= )[^aeiouy ]*(?= )"))
    return F.regexp_count(bare, F.lit("[aeiouy]+")) + silent, F.regexp_count(bare, F.lit(r"(?<= )[^aeiouy ]*(?:[aeiouy]+[^aeiouy ]+){2}[aeiouy][^ ]*"))


def first_words(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(space_words(text), 1, n), " ")


def first_chars(text: Column | str, n: int) -> Column:
    return F.substring(_c(text), 1, n)


def chunks(text: Column | str, size: int = 500, stride: int = 400) -> Column:
    """Overlapping chunks of words; texts of no more than ``stride`` words give none."""
    w = space_words(text)
    starts = F.when(F.size(w) > stride, F.sequence(F.lit(0), F.size(w) - stride - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(w, s + 1, size), " ").alias("chunk")))


def syllables(word: Column) -> Column:
    """Vowel groups after a silent ending is taken off; 1 for words of up to three letters."""
    w = F.lower(word)
    bare = F.regexp_replace(F.regexp_replace(w, r"(?:[^aeiouy]es|ed|[^aeiouy]e)$", ""), "^y", "")
    return F.when(F.length(w) <= 3, F.lit(1)).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]+"))))


def language(text: Column | str, sample: int = 500) -> Column:
    """Language by script and function words of the first ``sample`` characters, as the definition has it; ties go to en, es, fr, de in turn; unknown if none occurs."""
    head = F.substring(_c(text), 1, sample)
    low = F.lower(head)
    count = lambda m: F.size(F.split(low, m)) - 1
    scores = {lang: sum((count(m) for m in marks), F.lit(0)) for lang, marks in L.LANGUAGE_MARKERS.items()}
    top = F.greatest(*scores.values())
    pick = F.when(top == 0, "unknown")
    for lang, score in scores.items():
        pick = pick.when(score == top, lang)
    return F.when(F.regexp_count(head, F.lit(r"[\x{4e00}-\x{9fff}]")) > F.length(head) * 0.1, "zh").otherwise(pick)


def defensive(text: Column | str, composed: Column | None = None) -> Column:
    """Hidden characters out, look-alikes to Latin, repeated punctuation to one, white space to single blanks; "" for null. ``composed``: the text after NFC, where available."""
    t = F.regexp_replace(composed if composed is not None else _c(text), L.HIDDEN_CHARACTERS, "")
    t = F.translate(t, L.HOMOGLYPHS_FROM, L.HOMOGLYPHS_TO)
    t = F.regexp_replace(t, r"[ \t\r\n]{2,}", " ")
    t = F.regexp_replace(t, r"([^\p{L}\p{N}_\s\x0b\p{Z}\x{85}\x{1c}-\x{1f}])\1{2,}", "$1")
    return F.coalesce(strip(F.regexp_replace(t, SPACE + "+", " ")), F.lit(""))


def rebuilt(df: DataFrame, id_col: str, index: str) -> DataFrame:
    """(id, rebuilt): texts from their inverted indexes, JSON objects of word to positions. Gaps stay as empty words, so their blanks add up; of several words at a place the last in the index wins."""
    entries = df.select(id_col, F.posexplode(F.map_entries(F.from_json(index, "map<string,array<int>>"))).alias("_order", "_e"))
    places = entries.select(id_col, "_order", F.col("_e.key").alias("_word"), F.explode("_e.value").alias("_at"))
    words = places.groupBy(id_col, "_at").agg(F.max_by("_word", "_order").alias("_word"))
    ordered = words.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", "_word"))).alias("_all"))
    spaced = F.transform("_all", lambda x, i: F.concat(F.repeat(F.lit(" "), x["_at"] - F.coalesce(F.get("_all", i - 1)["_at"], F.lit(0))), x["_word"]))
    return ordered.select(id_col, F.array_join(spaced, "").alias("rebuilt"))


def plain_look_alikes(compatible: Column) -> Column:
    """Of a text in NFKC: Cyrillic look-alikes, dashes and curly quotes to ASCII, the ellipsis to three dots."""
    return F.replace(F.translate(compatible, L.PLAIN_FROM, L.PLAIN_TO), F.lit("…"), F.lit("..."))
