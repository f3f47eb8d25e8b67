"""Texts that look the same but differ in their characters, brought to one form.

Method: each text is mapped character by character (styled and look-alike letters to plain ones, joined
letters apart, all single spaces to one, characters that show nothing removed); the mapped values are
grouped in SQL under the accent-sensitive collation UNICODE, which equates composed and decomposed
accents; the smallest member in binary order is the class's canonical form and is joined back.

To find rows of two tables in one class, candidates come first from a hash of a coarser form without
accents, which is equal wherever the classes are: hashes whose rows all hold one text, or that occur in
one table only, need no collation. This drops no pair.

Defined results: a null text is in no class and keeps a null form; an empty text's form is empty; case,
punctuation, line breaks and accents stay different; copies of one text share a form but are no pair;
empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE
from lectern.plans.stage import written

# Letters of other scripts by the Latin letter they look like.
LOOKS_LIKE = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ",
    "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս",
    "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥУ", "Z": "ΖᏃ",
    "a": "аαɑ", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιɩ", "j": "јϳ", "k": "кκ", "l": "ӏ",
    "n": "ո", "o": "оοօσ", "p": "рρ", "q": "ԛգ", "r": "г", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝա", "x": "хχ", "y": "уүγ",
    "z": "ᴢ",
}
#: Compatibility forms that differ from the plain letter in style only.
STYLED = ("<font>", "<wide>", "<narrow>", "<noBreak>")
#: Characters that show nothing and are neither format characters nor variation selectors by class.
BLANK = "͏ᅟᅠ឴឵ㅤﾠ"


@cache
def character_map() -> tuple[dict[str, str], dict[str, str]]:
    """Single characters to a single character or "" (removed), and joined letters to several. Made by rule over all code points."""
    plain = {c: latin for latin, others in LOOKS_LIKE.items() for c in others}
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for i in [*range(0x20), *range(0x7F, 0x20000), *range(0xE0000, 0xE0200)]:
        ch = chr(i)
        kind = unicodedata.category(ch)
        if kind in ("Cs", "Cn", "Co"):
            continue
        tag, _, _ = unicodedata.decomposition(ch).partition(" ")
        if kind in ("Cf", "Cc") and ch not in "\t\n\v\f\r\x85\x1c\x1d\x1e\x1f" or ch in BLANK or unicodedata.name(ch, "").startswith(("VARIATION SELECTOR", "MONGOLIAN FREE VARIATION")):
            single[ch] = ""
        elif kind == "Zs":
            single[ch] = " "
        elif tag == "<compat>" and kind in ("Ll", "Lu", "Lt") and len(flat := unicodedata.normalize("NFKC", ch)) > 1 and flat.isalpha():
            several[ch] = flat
        else:
            # Look-alikes under their accents: decomposed, mapped, composed again.
            source = unicodedata.normalize("NFKC" if tag in STYLED else "NFC", ch)
            apart = unicodedata.normalize("NFD", source)
            to = unicodedata.normalize("NFC", "".join(plain.get(c, c) for c in apart))
            if to != ch and len(to) == 1 and (tag in STYLED or to != source):
                single[ch] = to
    return single, several


@cache
def bases() -> dict[str, str]:
    """Accented letters to their base letter; combining marks to ""."""
    out = {}
    for i in range(0x80, 0x20000):
        ch = chr(i)
        if unicodedata.category(ch) == "Mn":
            out[ch] = ""
        elif (apart := unicodedata.normalize("NFD", ch)) != ch and len(base := "".join(c for c in apart if unicodedata.category(c) != "Mn")) == 1:
            out[ch] = base
    return out


def _translate(text: Column, table: dict[str, str]) -> Column:
    """One pass over the characters; ASCII texts are returned as they are."""
    kept, gone = [c for c, to in table.items() if to], [c for c, to in table.items() if not to]
    return F.translate(text, "".join(kept + gone), "".join(table[c] for c in kept))


def _mapped(text: Column, table: dict[str, str]) -> Column:
    _, several = character_map()
    apart = text
    for ch, to in several.items():
        apart = F.replace(apart, F.lit(ch), F.lit(to))
    apart = F.when(text.rlike("[" + "".join(several) + "]"), apart).otherwise(text)
    # A text that takes one byte a character and has no control characters is its own form.
    plain = (F.octet_length(text) == F.length(text)) & ~text.rlike(r"[\x00-\x08\x0e-\x1b\x7f]")
    return F.when(plain, text).otherwise(_translate(apart, table))


def mapped(text: Column) -> Column:
    """The text with look-alike, styled and joined letters, spaces and invisible characters mapped; accents as they were."""
    return _mapped(text, character_map()[0])


def skeleton(text: Column) -> Column:
    """The mapped text without accents: equal for all texts of a class."""
    single, base = character_map()[0], bases()
    both = {c: base.get(c, c) for c in base} | {c: base.get(to, to) for c, to in single.items()}
    return _mapped(text, both)


def forms(values: DataFrame) -> DataFrame:
    """Of mapped values (column m): each distinct value and its class's canonical member, by grouping under the collation in SQL."""
    return values.sparkSession.sql(
        """
        WITH v AS (SELECT DISTINCT m FROM {values} WHERE m IS NOT NULL),
        -- Without invisible characters, an ASCII value is equal to no other under the collation.
        wide AS (SELECT m FROM v WHERE octet_length(m) <> char_length(m)),
        classes AS (SELECT m COLLATE UNICODE AS k, min(m) AS canon FROM wide GROUP BY m COLLATE UNICODE)
        SELECT m, m AS canon FROM v WHERE octet_length(m) = char_length(m)
        UNION ALL
        SELECT wide.m, classes.canon FROM wide JOIN classes ON wide.m COLLATE UNICODE = classes.k
        """,
        values=values,
    )


def one_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form): every row of ``df`` with its text's canonical form."""
    rows = df.select(F.col(id_col).alias("id"), mapped(F.col(text_col)).alias("m"))
    return rows.join(forms(rows.select("m")), "m", "left").select("id", F.col("canon").alias("form"))


def form_hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form): every row with the SHA-256 of its text's canonical form; null texts have none.

    Only texts outside ASCII can have another canonical form than their own, and only in classes (by the hash of
    the accent-free form) with several mapped forms; no other text leaves the task that read it.
    """
    m = mapped(F.col(text_col))
    wide = F.when(F.octet_length("m") != F.length("m"), F.col("m"))
    rows = df.select(F.col(id_col).alias("id"), m.alias("m"), F.xxhash64(skeleton(F.col(text_col))).alias("s"))
    narrow = written(rows.select("id", "s", F.sha2("m", 256).alias("form"), wide.alias("m")))
    several = narrow.filter("m is not null").groupBy("s").agg(F.min("form").alias("a"), F.max("form").alias("b"))
    several = written(several.filter("a <> b").select("s", F.lit(True).alias("torn")))
    placed = narrow.join(several, "s", "left")
    torn = placed.filter("torn and m is not null").select("id", "m")
    told = torn.join(forms(torn.select("m")), "m").select("id", F.sha2("canon", 256).alias("form"))
    return placed.filter("torn is null or m is null").select("id", "form").unionAll(told)


def word_count_at_least(text: Column, n: int) -> Column:
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")) >= n


def alike(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_col: str = "text", least_words: int = 20) -> DataFrame:
    """Pairs of a row of ``left`` (of at least ``least_words`` words) and one of ``right`` whose texts look the same but differ in characters."""
    pick = lambda df, key, tab: df.select(F.lit(tab).alias("tab"), F.col(key).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    rows = pick(left, left_id, 0).unionAll(pick(right, right_id, 1))
    narrow = written(rows.select("tab", "id", F.xxhash64(skeleton(F.col("text"))).alias("s"), F.xxhash64("text").alias("t")))
    mixed = narrow.groupBy("s").agg(F.min("tab").alias("t0"), F.max("tab").alias("t1"), F.min("t").alias("h0"), F.max("t").alias("h1")).filter("t0 < t1 and h0 <> h1").select("s")
    wanted = written(narrow.join(mixed, "s", "left_semi").select("tab", "id").distinct())
    chosen = written(rows.join(wanted, ["tab", "id"], "left_semi").withColumn("m", mapped(F.col("text"))))
    canon = forms(chosen.select("m"))
    placed = chosen.join(canon, "m").select("tab", "id", "text", F.col("canon"))
    a = placed.filter("tab = 0").filter(word_count_at_least(F.col("text"), least_words)).select(F.col("id").alias(left_id), F.col("text").alias("text_a"), "canon")
    b = placed.filter("tab = 1").select(F.col("id").alias(right_id), F.col("text").alias("text_b"), "canon")
    return a.join(b, "canon").filter("text_a <> text_b").select(left_id, right_id).distinct()
