"""Queries over document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import documents, query, table
from lectern.functions import features as FX
from lectern.functions import kernel
from lectern.functions import text as X
from lectern.functions import wordlists as L
from lectern.functions.unicode import nfc, nfkc
from lectern.operators import corpus, perturb, sampling, scoring, stats, windows

# ---- SQL building blocks -------------------------------------------------------------------------------------------
SP = r"[\s\x0b\p{Z}\x{85}\x{1c}-\x{1f}]"
LETTERED = r"[\p{N}_]*\p{L}[\p{L}\p{N}_]*"
CJK = r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_sql(x: str) -> str:
    return f"CASE WHEN len(regexp_extract_all({x}, '{CJK}')) > length({x}) * 0.1 THEN list_filter(string_split(lower({x}), ''), lambda c: regexp_matches(c, '[\\p{{L}}\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]')) ELSE regexp_extract_all(lower({x}), '{LETTERED}') END"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def sentences_sql(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace({strip_sql(x)}, '([.!?]){SP}+([A-Z\"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: {strip_sql('p')}), lambda p: p <> '')"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{x}] END"


def in_list(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def count_sql(words: list[str], tokens: str = "w") -> str:
    return f"len(list_filter({tokens}, lambda t: list_contains({in_list(words)}, t)))"


def density(c: str) -> str:
    return f"({c}) / greatest(n / 1000.0, 0.001)"


def deviation_sql(x: str, ddof: int = 1) -> str:
    f = "stddev_samp" if ddof else "stddev_pop"
    return f"CASE WHEN len({x}) > 1 THEN list_aggregate({x}, '{f}') ELSE 0.0 END"


def chars_sql(chars: str) -> str:
    return f"(length(text) - length(translate(text, {q(chars)}, '')))"


def space_words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SP}+'), lambda t: t <> '')"


DOCS = "documents WHERE text IS NOT NULL"


# ---- tokenisers ----------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, (unnest(range(len(s))))::BIGINT AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM {DOCS})")
def t1_sentences(spark, d):
    return windows.sentence_rows(documents(spark, d), "doc_id")


@query(
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+["''\s]*|[^.!?]+$') AS parts FROM {DOCS}),
    e AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM p),
    o AS (SELECT doc_id, i, part, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM e)
    SELECT doc_id, {strip_sql('part')} AS sentence, (stop - length(part))::BIGINT AS start_at, stop::BIGINT AS end_at FROM o WHERE regexp_matches(part, '[\p{{L}}\p{{N}}_]')"""
)
def t2_sentence_offsets(spark, d):
    return documents(spark, d).select("doc_id", F.explode(X.sentence_offsets("text")).alias("s")).select("doc_id", F.col("s.text").alias("sentence"), F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query(
    rf"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n{{2,}}', ' <PARA> ', 'g'), '\n', ' ', 'g') AS t FROM {DOCS}),
    p AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: string_split(x, '<PARA>'))), lambda x: {strip_sql('x')}), lambda x: x <> '') AS s FROM m)
    SELECT doc_id, len(s)::BIGINT AS sentences, round(coalesce(list_avg(list_transform(s, lambda x: length(x))), 0), 6)::DOUBLE AS mean_chars FROM p"""
)
def t3_paragraph_sentences(spark, d):
    s = documents(spark, d).select("doc_id", X.paragraph_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.aggregate(F.transform("s", F.length), F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("s"), F.lit(0)), F.lit(0.0)).alias("mean_chars"))


@query(
    rf"""WITH p AS (SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+(?:\s|$)|\n+'), lambda x: {strip_sql('x')}), lambda x: x <> ''))::BIGINT AS loose,
    len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::BIGINT AS by_space, greatest(1, {chars_sql('.?!')})::BIGINT AS by_stops FROM {DOCS}) SELECT * FROM p"""
)
def t4_t6_sentence_counts(spark, d):
    return documents(spark, d).select("doc_id", F.size(X.loose_sentences("text")).alias("loose"), F.size(X.stop_sentences("text")).alias("by_space"), X.stop_count("text").alias("by_stops"))


@query(
    rf"""SELECT doc_id, len({words_sql('text')})::BIGINT AS lettered, len(list_distinct({words_sql('text')}))::BIGINT AS distinct_words,
    len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]+')))::BIGINT AS ascii_only,
    len(regexp_extract_all(text, '[a-zA-Z]+(?:''[a-z]+)?'))::BIGINT AS with_apostrophe, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))::BIGINT AS all_tokens, len({space_words_sql('text')})::BIGINT AS by_space FROM {DOCS}"""
)
def t7_t11_word_counts(spark, d):
    w = documents(spark, d).select("doc_id", "text", X.words("text").alias("w"))
    return w.select("doc_id", F.size("w").alias("lettered"), F.size(F.array_distinct("w")).alias("distinct_words"), F.size(X.ascii_words("text")).alias("ascii_only"), F.size(X.apostrophe_words("text")).alias("with_apostrophe"), F.size(X.tokens("text")).alias("all_tokens"), F.size(X.space_words("text")).alias("by_space"))


@query(f"SELECT doc_id, list_aggregate(list_slice({space_words_sql('text')}, 1, 300), 'string_agg', ' ') AS words_300, left(text, 3000) AS chars_3000 FROM {DOCS} AND len({space_words_sql('text')}) > 0")
def t12_t13_truncated(spark, d):
    return documents(spark, d).filter(F.size(X.space_words("text")) > 0).select("doc_id", X.first_words("text", 300).alias("words_300"), X.first_chars("text", 3000).alias("chars_3000"))


@query(f"WITH w AS (SELECT doc_id, {space_words_sql('text')} AS w FROM {DOCS}), c AS (SELECT doc_id, w, unnest(range(0, len(w) - 400, 400)) AS s FROM w WHERE len(w) > 400) SELECT doc_id, s::BIGINT AS start_at, list_aggregate(list_slice(w, s + 1, s + 500), 'string_agg', ' ') AS chunk FROM c")
def t14_chunks(spark, d):
    return documents(spark, d).select("doc_id", F.explode(X.chunks("text")).alias("c")).select("doc_id", F.col("c.start").alias("start_at"), F.col("c.chunk").alias("chunk"))


@query(f"SELECT doc_id, nfc_normalize(text) AS nfc FROM {DOCS}")
def t16_nfc(spark, d):
    return documents(spark, d).select("doc_id", nfc("text").alias("nfc"))


@query()
def t16_nfkc(spark, d):
    return documents(spark, d).select("doc_id", nfkc("text").alias("nfkc"))


@query(
    rf"""WITH a AS (SELECT request_id, received_at, regexp_replace(translate(regexp_replace(nfc_normalize(text), '{L.HIDDEN_CHARACTERS}', '', 'g'), {q(L.HOMOGLYPHS_FROM)}, {q(L.HOMOGLYPHS_TO)}), '[ \t\r\n]{{2,}}', ' ', 'g') AS t FROM detect_request)
    SELECT request_id, received_at, length(t)::BIGINT AS before_repeats FROM a"""
)
def t17_defensive_stages(spark, d):
    r = table(spark, d, "detect_request", "request_id", "received_at", "text")
    t = F.translate(F.regexp_replace(nfc("text"), L.HIDDEN_CHARACTERS, ""), L.HOMOGLYPHS_FROM, L.HOMOGLYPHS_TO)
    return r.select("request_id", "received_at", F.length(F.regexp_replace(t, r"[ \t\r\n]{2,}", " ")).alias("before_repeats"))


@query()
def t17_defensive(spark, d):
    return table(spark, d, "detect_request", "request_id", "received_at", "text").select("request_id", "received_at", X.defensive("text", nfc("text")).alias("clean"))


@query(f"SELECT doc_id, list_aggregate(w, 'string_agg', ' ') AS rebuilt FROM (SELECT doc_id, {space_words_sql('text')} AS w FROM {DOCS}) WHERE len(w) > 0")
def t19_rebuilt_from_index(spark, d):
    w = documents(spark, d).select("doc_id", F.posexplode(X.space_words("text")).alias("at", "word"))
    index = w.groupBy("doc_id", "word").agg(F.array_sort(F.collect_list("at")).alias("places")).groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "places")))).alias("inverted"))
    return X.rebuilt(index, "doc_id", "inverted")


SYLLABLES_SQL = "CASE WHEN length(word) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(word, '(?:[^aeiouy]es|ed|[^aeiouy]e)$', ''), '^y', ''), '[aeiouy]+'))) END"


@query(f"WITH w AS (SELECT unnest({words_sql('text')}) AS word FROM {DOCS}) SELECT word, ({SYLLABLES_SQL})::BIGINT AS syllables, count(*)::BIGINT AS n FROM w GROUP BY 1")
def t20_syllables(spark, d):
    w = documents(spark, d).select(F.explode(X.words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.select("word", X.syllables(F.col("word")).alias("syllables"), "n")


def language_sql() -> str:
    score = {k: " + ".join(f"len(string_split(low, '{m}')) - 1" for m in marks) for k, marks in L.LANGUAGE_MARKERS.items()}
    cols = ", ".join(f"({v}) AS s_{k}" for k, v in score.items())
    top = "greatest(s_en, s_es, s_fr, s_de)"
    return f"""WITH h AS (SELECT doc_id, text, left(text, 500) AS head, lower(left(text, 500)) AS low FROM {DOCS}), c AS (SELECT doc_id, text, head, {cols} FROM h)
    SELECT doc_id, text, CASE WHEN len(regexp_extract_all(head, '[\\x{{4e00}}-\\x{{9fff}}]')) > length(head) * 0.1 THEN 'zh' WHEN {top} = 0 THEN 'unknown' WHEN s_en = {top} THEN 'en' WHEN s_es = {top} THEN 'es' WHEN s_fr = {top} THEN 'fr' ELSE 'de' END AS language FROM c"""


@query(f"SELECT doc_id, language FROM ({language_sql()})")
def t21_language(spark, d):
    return documents(spark, d).select("doc_id", X.language("text").alias("language"))


def _by_language_sql() -> str:
    kinds = ("hedge", "booster", "connector", "self_mention")
    pick = lambda k: "CASE language " + " ".join(f"WHEN '{lang}' THEN {count_sql(L.LANGUAGES[lang][k])}" for lang in L.LANGUAGES) + f" ELSE {count_sql(L.lists_of('en')[k])} END"
    cols = ", ".join(f"round({density(pick(k))}, 6)::DOUBLE AS {k}_density" for k in kinds)
    return f"WITH t AS ({language_sql()}), b AS (SELECT doc_id, language, {words_sql('text')} AS w FROM t), n AS (SELECT *, len(w) AS n FROM b) SELECT doc_id, language, n::BIGINT AS n_words, {cols} FROM n"


@query(_by_language_sql())
def t22_lists_by_language(spark, d):
    return FX.by_language(documents(spark, d)).drop("text")


# ---- features ------------------------------------------------------------------------------------------------------
def phrase_sql(choices: list[str], source: str = "lower(text)") -> str:
    """Whole-word matches: word characters around each candidate are looked at after framing every word by blanks, since RE2 has no look-around."""
    framed = f"regexp_replace({source}, '([\\p{{L}}\\p{{N}}_]+)', chr(2) || '\\1' || chr(3), 'g')"
    alternatives = "|".join("\\x02" + w.replace(" ", "\\x03 \\x02") + "\\x03" for w in sorted(choices, key=lambda w: (-len(w), w)))
    return f"len(regexp_extract_all({framed}, '{alternatives}'))"


def _native_sql(digits: int = 6) -> str:
    opener = "^(?:" + "|".join(L.CONNECTORS) + ")[ ,]"
    ends = lambda suffixes, least: f"len(list_filter(w, lambda t: length(t) >= {least} AND regexp_matches(t, '(?:{'|'.join(suffixes)})$')))"
    syl = "list_transform(w, lambda word: " + SYLLABLES_SQL + ")"
    punct = "[" + ", ".join(f"({chars_sql(c)})::DOUBLE" for c in L.PUNCTUATION) + "]"
    wps, spw = "(n / sents)", "(syl / greatest(n, 1))"
    f = {
        "mean_sent_len": "coalesce(list_avg(lens), 0)",
        "sent_cv": f"CASE WHEN len(lens) > 1 THEN ({deviation_sql('lens')}) / list_avg(lens) ELSE 0 END",
        "self_mention_density": density(count_sql(L.SELF_MENTIONS)),
        "connector_density": density(phrase_sql(L.CONNECTORS)),
        "opener_ratio": f"len(list_filter(s, lambda x: regexp_matches({strip_sql('lower(x)')}, '{opener}'))) / sents",
        "hedge_density": density(f"{count_sql(L.HEDGES)} + {phrase_sql(L.HEDGE_PHRASES)}"),
        "boost_density": density(count_sql(L.BOOSTERS)),
        "punct_entropy": "CASE WHEN list_sum(punct) > 0 THEN log2(list_sum(punct)) - list_sum(list_transform(punct, lambda c: CASE WHEN c > 0 THEN c * log2(c) ELSE 0 END)) / list_sum(punct) ELSE 0 END",
        "flesch_reading_ease": f"206.835 - 1.015 * {wps} - 84.6 * {spw}",
        "flesch_kincaid_grade": f"0.39 * {wps} + 11.8 * {spw} - 15.59",
        "gunning_fog": f"0.4 * ({wps} + 100.0 * many / greatest(n, 1))",
        "smog_index": "1.043 * sqrt(many * 30.0 / sents) + 3.1291",
        "positive_density": density("pos"),
        "negative_density": density("neg"),
        "sentiment_polarity": "(pos - neg) / greatest(pos + neg, 1)",
        "exclamation_density": density(chars_sql("!")),
        "question_density": density(chars_sql("?")),
        "subordination_density": density(count_sql(L.SUBORDINATORS)),
        "preposition_density": density(count_sql(L.PREPOSITIONS)),
        "adjective_density": density(ends(L.ADJECTIVE_SUFFIXES, 5)),
        "adverb_density": density(ends(["ly"], 4)),
        "nominalization_density": density(ends(L.NOMINALIZATION_SUFFIXES, 6)),
        "quote_density": density("len(regexp_extract_all(text, '\"[^\"]*\"|''[^'']*'''))"),
        "type_token_ratio": "coalesce(len(list_distinct(content)) / nullif(len(content), 0), 0)",
        "sent_length_std": deviation_sql("lens"),
    }
    cols = ", ".join(f"CASE WHEN n >= 5 THEN round(({v})::DOUBLE, {digits}) END AS {k}" for k, v in f.items())
    return f"""WITH a AS (SELECT doc_id, text, {words_sql('text')} AS w, {sentences_sql('text')} AS s FROM {DOCS}),
    b AS (SELECT *, len(w) AS n, greatest(1, len(s)) AS sents, list_filter(list_transform(s, lambda x: len({words_sql('x')})), lambda k: k > 0) AS lens, {syl} AS syls, {punct} AS punct,
      list_filter(w, lambda t: NOT list_contains({in_list(L.STOPWORDS)}, t) AND length(t) > 2) AS content, {count_sql(L.POSITIVES)} AS pos, {count_sql(L.NEGATIVES)} AS neg FROM a),
    c AS (SELECT *, list_sum(syls) AS syl, len(list_filter(syls, lambda k: k >= 3)) AS many FROM b)
    SELECT doc_id, n::BIGINT AS n_words, len(s)::BIGINT AS n_sents, {cols} FROM c"""


def framed_sql(source: str = "text") -> str:
    """A text in which RE2's ASCII word boundaries are Unicode ones: letters outside ASCII are underscores, spaces blanks."""
    letters = (
        r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}\x{370}-\x{373}\x{376}-\x{37d}\x{386}-\x{52f}"
        r"\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ff10}-\x{ff5a}]"
    )
    return f"regexp_replace(regexp_replace({source}, '{letters}', '_', 'g'), '{SP}', ' ', 'g')"


PATTERNS = {
    "passive_density": rf"(?i)\b(?:{'|'.join(L.PASSIVE_AUXILIARIES)})\s+(?:\w+ed|{'|'.join(L.PASSIVE_PARTICIPLES)})\b",
    "capitalized_entity_density": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
    "number_density": r"\b\d+(?:\.\d+)?\b",
    "acronym_density": r"\b[A-Z]{2,}s?\b",
    "url_email_density": r"https?://\S+|\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
}


def factors_sql(words: str) -> str:
    """Factors of lexical diversity in one direction: a fold over the words with the factors so far and the words seen."""
    step = (
        "lambda a, x: CASE WHEN len(list_distinct(list_append(a.seen, x))) / (a.n + 1) <= 0.72 "
        "THEN {'k': a.k + 1.0::DOUBLE, 'n': 0::INTEGER, 'seen': []::VARCHAR[]} "
        "ELSE {'k': a.k, 'n': a.n + 1::INTEGER, 'seen': list_distinct(list_append(a.seen, x))} END"
    )
    zero = "{'k': 0.0::DOUBLE, 'n': 0::INTEGER, 'seen': []::VARCHAR[]}"
    last = "lambda r: r.k + CASE WHEN r.n > 0 THEN (1 - len(r.seen) / r.n) / (1 - 0.72) ELSE 0 END"
    return f"list_transform([list_reduce({words}, {step}, {zero})], {last})[1]"


def diversity_sql(total: bool = False) -> str:
    """Words by factor: the mean of both directions; or words by the mean of the factors, 0 if there are none."""
    a, b = factors_sql("w"), factors_sql("list_reverse(w)")
    if total:
        return f"list_transform([({a} + {b}) / 2], lambda f: CASE WHEN f > 0 THEN len(w) / f ELSE 0 END)[1]"
    each = "lambda f: CASE WHEN f > 0 THEN len(w) / f ELSE len(w) END"
    return f"list_avg(list_transform([{a}, {b}], {each}))"


COUNTS_SQL = """tok AS (SELECT doc_id, unnest(content) AS x FROM b), tc AS (SELECT doc_id, x, count(*) AS c FROM tok GROUP BY 1, 2),
    cs AS (SELECT doc_id, sum(c * c) AS sq, count(*) FILTER (WHERE c = 1) AS hapax, sum(c) FILTER (WHERE c > 1) AS rep,
      sum(c) AS m, count(*) AS types, count(*) FILTER (WHERE c > 1) AS again FROM tc GROUP BY 1),
    g AS (SELECT doc_id, substring(t, unnest(range(1, length(t) - 1))::BIGINT, 3) AS x FROM b WHERE length(t) > 2),
    gc AS (SELECT doc_id, x, count(*) AS c FROM g GROUP BY 1, 2),
    gs AS (SELECT doc_id, sum(c) AS m, sum(c * log2(c)) AS h FROM gc GROUP BY 1)"""


@query(_native_sql())
def x_native_features(spark, d):
    return FX.native(documents(spark, d)).drop("text", *PATTERNS)


def _patterns_sql() -> str:
    cols = [
        f"CASE WHEN n >= 5 THEN round(({density(f'len(regexp_extract_all(t, {q(p)}))')})::DOUBLE, 6) END AS {k}"
        for k, p in PATTERNS.items()
    ]
    return (
        f"WITH a AS (SELECT doc_id, text, len({words_sql('text')}) AS n, {framed_sql()} AS t FROM {DOCS}) "
        f"SELECT doc_id, {', '.join(cols)} FROM a"
    )


@query(_patterns_sql())
def x_pattern_features(spark, d):
    return FX.native(documents(spark, d)).select("doc_id", *PATTERNS)


FLAT = f"regexp_replace(lower(text), '{SP}+', ' ', 'g')"
NOT_STOP = f"NOT list_contains({in_list(L.STOPWORDS)}, x) AND length(x) > 2"
CONTENT = {
    "char_entropy": "log2(gs.m) - gs.h / gs.m",
    "rep_rate": "coalesce(rep, 0) / cs.m",
    "hapax_legomena_ratio": "hapax / cs.m",
    "yules_k": "10000.0 * (sq - cs.m) / (cs.m * cs.m)",
    "simpsons_d": "CASE WHEN cs.m > 1 THEN 1 - sq / (cs.m * cs.m) END",
}


def _counted_sql(digits: int = 6) -> str:
    cols = [f"CASE WHEN n >= 5 THEN round(coalesce({v}, 0), {digits})::DOUBLE END AS {k}" for k, v in CONTENT.items()]
    return f"""WITH a AS (SELECT doc_id, {words_sql('text')} AS w, {FLAT} AS t FROM {DOCS}),
    b AS (SELECT *, len(w) AS n, list_filter(w, lambda x: {NOT_STOP}) AS content FROM a), {COUNTS_SQL}
    SELECT b.doc_id, {', '.join(cols)} FROM b LEFT JOIN cs USING (doc_id) LEFT JOIN gs USING (doc_id)"""


@query(_counted_sql())
def x_counted_features(spark, d):
    return FX.counted(documents(spark, d)).drop("text", "mtld")


def _mtld_sql(digits: int = 6) -> str:
    return f"""WITH a AS (SELECT doc_id, {words_sql('text')} AS w FROM {DOCS}) SELECT doc_id,
    CASE WHEN len(w) >= 10 THEN round({diversity_sql()}, {digits})::DOUBLE WHEN len(w) >= 5 THEN 0.0::DOUBLE END AS mtld FROM a"""


@query(_mtld_sql())
def x_mtld(spark, d):
    return FX.counted(documents(spark, d)).select("doc_id", "mtld")


def _original_sql() -> str:
    """The eleven original features, not rounded."""
    return (
        f"SELECT doc_id, {', '.join(FX.ORIGINAL)} FROM ({_native_sql(14)}) JOIN ({_counted_sql(14)}) USING (doc_id) "
        f"JOIN ({_mtld_sql(14)}) USING (doc_id)"
    )


def ascii_words_sql(x: str) -> str:
    tokens = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
    return f"list_filter({tokens}, lambda y: regexp_full_match(y, '[a-z]+'))"


def apostrophe_words_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[a-zA-Z]+(?:''[a-z]+)?'), lambda y: lower(y))"


def loose_sentences_sql(x: str) -> str:
    pieces = rf"regexp_split_to_array({strip_sql(x)}, '[.!?]+(?:{SP}|$)|\n+')"
    parts = f"list_filter(list_transform({pieces}, lambda p: {strip_sql('p')}), lambda p: p <> '')"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{x}] END"


OWN = {"hedge": L.HEDGES, "booster": L.BOOSTERS, "connector": L.CONNECTORS, "self_mention": L.SELF_MENTIONS}
LOUD = {
    "hedge": L.ADVERSARIAL_HEDGES, "booster": L.ADVERSARIAL_BOOSTERS, "connector": L.ADVERSARIAL_CONNECTORS,
    "self_mention": L.ADVERSARIAL_SELVES,
}


def _profile_sql(
    tokens, sentences: str, lists: dict[str, list[str]], stop: list[str], content: int, least: str, opener: str,
    punctuation: str, loud: bool = False, phrases: bool = False,
) -> str:
    """``loud``: the adversarial definitions of deviation, sentences, repetition, trigrams and diversity."""
    punct = "[" + ", ".join(f"({chars_sql(c)})::DOUBLE" for c in punctuation) + "]"
    spread = "list_sum(list_transform(punct, lambda c: CASE WHEN c > 0 THEN c * log2(c) ELSE 0 END))"
    f = {
        "mtld": diversity_sql(loud),
        "sent_cv": f"CASE WHEN list_avg(lens) > 0 THEN ({deviation_sql('lens', 0 if loud else 1)}) / list_avg(lens) ELSE 0 END",
        "self_mention_density": density(count_sql(lists["self_mention"])),
        "opener_ratio": f"len(list_filter(s, lambda x: {opener})) / len(s)",
        "connector_density": density((phrase_sql if phrases else count_sql)(lists["connector"])),
        "hedge_density": density(count_sql(lists["hedge"]) + (f" + {phrase_sql(L.HEDGE_PHRASES)}" if phrases else "")),
        "mean_sent_len": "list_avg(lens)",
        "boost_density": density(count_sql(lists["booster"])),
        "char_entropy": "coalesce(log2(gs.m) - gs.h / gs.m, 0)",
        "rep_rate": "coalesce(again / types, 0)" if loud else "coalesce(coalesce(rep, 0) / cs.m, 0)",
        "punct_entropy": f"CASE WHEN list_sum(punct) > 0 THEN log2(list_sum(punct)) - {spread} / list_sum(punct) ELSE 0 END",
    }
    cols = ", ".join(f"CASE WHEN {least} THEN round(({v})::DOUBLE, 6) END AS {k}" for k, v in f.items())
    lens = f"list_transform(s, lambda x: len({tokens('x')}))"
    lens = lens if loud else f"list_filter({lens}, lambda k: k > 0)"
    kept = f"list_filter(w, lambda x: NOT list_contains({in_list(stop)}, x) AND length(x) >= {content})"
    return f"""WITH a AS (SELECT doc_id, text, {tokens('text')} AS w, {sentences} AS s, {'text' if loud else FLAT} AS t FROM {DOCS}),
    b AS (SELECT *, len(w) AS n, {lens} AS lens, {punct} AS punct, {kept} AS content FROM a), {COUNTS_SQL}
    SELECT b.doc_id, n::BIGINT AS n_words, len(s)::BIGINT AS n_sents, {cols}
    FROM b LEFT JOIN cs USING (doc_id) LEFT JOIN gs USING (doc_id)"""


def _opens(connectors: list[str], after: str) -> str:
    return f"regexp_matches({strip_sql('lower(x)')}, '^(?:{'|'.join(connectors)}){after}')"


@query(
    _profile_sql(
        ascii_words_sql, sentences_sql("text"), OWN | {"hedge": L.TRAIN_HEDGES, "connector": L.TRAIN_CONNECTORS},
        L.TRAIN_STOPWORDS, 3, "n >= 50 AND length(text) >= 30", _opens(L.TRAIN_CONNECTORS, r"[\s,]"), L.PUNCTUATION + "`",
    )
)
def x_train_profile(spark, d):
    return FX.profile_features(documents(spark, d), "train").drop("text")


@query(
    _profile_sql(
        ascii_words_sql, sentences_sql("text"), OWN, L.STOPWORDS, 3, "n >= 20", _opens(L.CONNECTORS, "[ ,]"),
        L.PUNCTUATION, phrases=True,
    )
)
def x_v0_profile(spark, d):
    return FX.profile_features(documents(spark, d), "v0").drop("text")


@query(
    _profile_sql(
        apostrophe_words_sql, loose_sentences_sql("text"), LOUD, L.ADVERSARIAL_STOPWORDS, 0,
        f"n >= 10 AND len(s) >= 2 AND length({strip_sql('text')}) >= 50",
        f"list_contains({in_list(L.ADVERSARIAL_CONNECTORS)}, ({apostrophe_words_sql('x')})[1])",
        L.PUNCTUATION.replace("{", "").replace("}", ""), loud=True,
    )
)
def x_adversarial_profile(spark, d):
    return FX.profile_features(documents(spark, d), "adversarial").drop("text")


@query()
def x_record(spark, d):
    """All 39 features of each text in NFKC, by the language found in it."""
    return FX.record(documents(spark, d)).drop("text")


@query()
def x_agnostic(spark, d):
    """The features that need no language."""
    return FX.agnostic(documents(spark, d)).drop("text")


@query()
def x_vector(spark, d):
    """The features in a model's order as an array; names that are no feature give 0."""
    names = [*FX.ALL, "no_such_feature"]
    v = kernel.vector(documents(spark, d), names, lang=None, compose=True)
    return v.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).cast("string").alias("vector"))


def style(spark, d, *columns):
    return kernel.with_features(documents(spark, d, *columns), columns=STYLE).drop("text")


STYLE = ["mean_sent_len", "sent_cv", "self_mention_density", "connector_density", "opener_ratio", "hedge_density", "boost_density", "punct_entropy", "type_token_ratio", "preposition_density"]
def _effects_sql(features: str, names: list[str], digits: int, more: bool) -> str:
    """``more``: with deviations."""
    r = lambda x: f"round({x}, {digits})::DOUBLE"
    sds = f"{r('sqrt(v0)')} AS human_sd, {r('sqrt(v1)')} AS ai_sd," if more else ""
    on = lambda f, k: f"{f}(value) FILTER (WHERE label = {k})"
    d = "CASE WHEN n0 < 2 OR n1 < 2 THEN NULL WHEN sd = 0 THEN 0.0 ELSE (m1 - m0) / nullif(sd, 0) END"
    return f"""WITH f AS ({features}), l AS (SELECT doc_id, coalesce(nullif(lower(trim(lang)), ''), 'unknown') AS language, label FROM documents WHERE label IN (0, 1)),
    long AS (SELECT language, label, feature, value FROM (SELECT * FROM f JOIN l USING (doc_id)) UNPIVOT (value FOR feature IN ({', '.join(names)}))),
    both_ AS (SELECT language, label, feature, value FROM long UNION ALL SELECT 'all', label, feature, value FROM long),
    m AS (SELECT language, feature, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1, {on('avg', 0)} AS m0,
      {on('avg', 1)} AS m1, {on('var_samp', 0)} AS v0, {on('var_samp', 1)} AS v1 FROM both_ GROUP BY 1, 2),
    p AS (SELECT *, sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / nullif(n0 + n1 - 2, 0)) AS sd FROM m)
    SELECT language, feature, n0::BIGINT AS n_human, n1::BIGINT AS n_ai, {r('m0')} AS human_mean, {sds} {r('m1')} AS ai_mean, {r(d)} AS cohens_d FROM p"""


EFFECTS_SQL = _effects_sql(_native_sql(), STYLE, 4, False)


@query(EFFECTS_SQL)
def effect_sizes(spark, d):
    """Effect sizes of style features by language and over all: the flagship query."""
    f = style(spark, d, "lang", "label").filter("label in (0, 1)").withColumn("language", F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("unknown")))
    e = stats.effect_sizes_wide(f, "language", STYLE)
    return e.select("language", "feature", "n_human", "n_ai", *[F.round(c, 4).alias(c) for c in ("human_mean", "ai_mean", "cohens_d")])


def original(spark, d, *columns):
    """The eleven features that the norms are of."""
    return kernel.with_features(documents(spark, d, *columns), columns=FX.ORIGINAL).drop("text", "n_words", "n_sents")


@query(_effects_sql(_original_sql(), FX.ORIGINAL, 6, True))
def effect_sizes_original(spark, d):
    """Effect sizes of the eleven original features by language and over all."""
    f = original(spark, d, "lang", "label").filter("label in (0, 1)").withColumn("language", F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("unknown")))
    return stats.effect_sizes_wide(f, "language", FX.ORIGINAL)


def _explained_sql() -> str:
    z = "CASE WHEN human_sd > 0 THEN (value - human_mean) / human_sd ELSE 0.0 END"
    return f"""WITH f AS ({_original_sql()}), l AS (SELECT doc_id, coalesce(n.register, 'all') AS norm_register FROM documents d
      LEFT JOIN (SELECT DISTINCT register FROM effect_sizes) n ON n.register = lower(trim(d.register)) WHERE text IS NOT NULL),
    long AS (SELECT * FROM (SELECT * FROM f JOIN l USING (doc_id)) UNPIVOT (value FOR feature IN ({', '.join(FX.ORIGINAL)}))),
    z AS (SELECT doc_id, feature, norm_register, cohens_d, {z} AS z FROM long JOIN effect_sizes e ON e.register = norm_register AND e.feature = long.feature)
    SELECT doc_id, feature, norm_register, round(z, 6)::DOUBLE AS z_score, coalesce((cohens_d > 0 AND z > 0.5) OR (cohens_d < 0 AND z < -0.5), false) AS deviation_towards_ai FROM z"""


@query(_explained_sql().replace("SELECT doc_id, feature, norm_register, cohens_d", "SELECT doc_id, long.feature, norm_register, cohens_d"))
def m9_explained(spark, d):
    """z-scores of the eleven original features against the norms of the document's register."""
    norms = table(spark, d, "effect_sizes", "register", "feature", "human_mean", "human_sd", "cohens_d")
    f = original(spark, d, "register").withColumn("register", F.lower(F.trim("register")))
    return scoring.explained(stats.long_form(f, ["doc_id", "register"], FX.ORIGINAL), norms).select("doc_id", "feature", "norm_register", "z_score", "deviation_towards_ai")


# ---- corpus --------------------------------------------------------------------------------------------------------
@query(
    "SELECT source, CASE "
    + " ".join(f"WHEN contains(lower(coalesce(source, 'none')), '{k}') THEN '{v}'" for k, v in L.SOURCE_REGISTERS)
    + " ELSE 'other' END AS register, count(*)::BIGINT AS n FROM corpus_raw GROUP BY 1, 2"
)
def f1_register_of_source(spark, d):
    return table(spark, d, "corpus_raw", "source").select("source", corpus.register_of_source(F.col("source")).alias("register")).groupBy("source", "register").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE " + " ".join(f"WHEN domain = '{k}' THEN '{v}'" for k, v in L.DOMAIN_REGISTERS.items()) + " END AS register, count(*)::BIGINT AS n FROM (SELECT split_part(source, '_', 2) AS domain FROM corpus_raw) GROUP BY 1 HAVING register IS NOT NULL")
def f2_register_of_domain(spark, d):
    return table(spark, d, "corpus_raw", "source").select(corpus.register_of_domain(F.try_element_at(F.split("source", "_"), F.lit(2))).alias("register")).filter("register is not null").groupBy("register").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_id FROM corpus_raw WHERE len({space_words_sql('text')}) >= CASE lower(trim(register)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.LEAST_WORDS.items()) + " ELSE 50 END AND length(trim(text)) > 50")
def f3_f4_long_enough(spark, d):
    c = table(spark, d, "corpus_raw", "row_id", "register", "text")
    return corpus.long_enough(c.filter(F.length(F.trim("text")) > 50), F.lower(F.trim("register")), F.col("text")).select("row_id")


@query("SELECT row_id FROM corpus_raw WHERE coalesce(try_cast(substr(CAST(pub_year AS VARCHAR), 1, 4) AS INTEGER), 0) < 2022 AND lower(trim(coalesce(model, ''))) IN ('human', 'human_source', '')")
def f7_f8_before_and_human(spark, d):
    c = table(spark, d, "corpus_raw", "row_id", "model", "pub_year").withColumn("day", F.col("pub_year").cast("string"))
    return corpus.before_year(c, F.col("day")).filter(F.lower(F.trim(F.coalesce("model", F.lit("")))).isin("human", "human_source", "")).select("row_id")


@query("SELECT lower(trim(register)) AS register, count(*)::BIGINT AS n FROM corpus_raw WHERE register IS NOT NULL AND label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) = 2 AND count(*) >= 100")
def f9_eligible_groups(spark, d):
    c = table(spark, d, "corpus_raw", "register", "label").dropna(subset=["register", "label"]).select(F.lower(F.trim("register")).alias("register"), "label")
    return c.groupBy("register").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels")).filter("labels = 2 and n >= 100").select("register", "n")


@query(
    "SELECT CASE WHEN model IS NULL THEN 'human' "
    + " ".join(f"WHEN {' OR '.join(f'contains(lower(model), {q(k)})' for k in keys)} THEN '{g}'" for g, keys in L.MODEL_GROUPS)
    + " ELSE 'other' END AS family, count(*)::BIGINT AS n FROM corpus_raw GROUP BY 1"
)
def f12_model_groups(spark, d):
    return table(spark, d, "corpus_raw", "model").select(corpus.model_group(F.col("model")).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(row_id) AS row_id, count(*)::BIGINT AS copies FROM corpus_raw WHERE text IS NOT NULL GROUP BY text")
def o7_exact_dedup(spark, d):
    c = table(spark, d, "corpus_raw", "row_id", "text").filter("text is not null")
    return c.groupBy("text").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies")).select("row_id", "copies")


@query("SELECT min(row_id) AS row_id FROM corpus_raw WHERE text IS NOT NULL GROUP BY left(text, 200)")
def o8_prefix_dedup(spark, d):
    c = table(spark, d, "corpus_raw", "row_id", "text").filter("text is not null").select("row_id", F.left("text", F.lit(200)).alias("head"))
    return corpus.first_of_each(c, [F.col("head")], [F.col("row_id")]).select("row_id")


@query("SELECT min(request_id) AS request_id FROM detect_request r WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM corpus_raw c WHERE left(c.text, 200) = left(r.text, 200)) GROUP BY left(text, 200)")
def j1_new_texts(spark, d):
    new = table(spark, d, "detect_request", "request_id", "text").filter("text is not null")
    known = table(spark, d, "corpus_raw", "text")
    return corpus.without_known(new.withColumn("head", F.left("text", F.lit(200))).drop("text"), known.withColumn("head", F.left("text", F.lit(200))), F.col("head"), F.col("head"), [F.col("request_id")]).select("request_id")


@query("SELECT lower(trim(register)) AS register, label, source, count(*)::BIGINT AS n FROM corpus_raw GROUP BY ALL")
def a1_corpus_summary(spark, d):
    return table(spark, d, "corpus_raw", "register", "label", "source").groupBy(F.lower(F.trim("register")).alias("register"), "label", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(lower(trim(register)), 'none') AS register, count(*) FILTER (WHERE label = 0)::BIGINT AS human, count(*) FILTER (WHERE label = 1)::BIGINT AS ai, count(*)::BIGINT AS total FROM corpus_raw GROUP BY ROLLUP (lower(trim(register)))")
def a26_corpus_table(spark, d):
    c = table(spark, d, "corpus_raw", "register", "label").withColumn("r", F.lower(F.trim("register")))
    n = lambda k: F.count(F.when(F.col("label") == k, 1))
    return c.rollup("r").agg(n(0).alias("human"), n(1).alias("ai"), F.count(F.lit(1)).alias("total")).select(F.coalesce("r", F.lit("none")).alias("register"), "human", "ai", "total")


@query("SELECT doc_id, text, label FROM (SELECT item_id AS doc_id, passage AS text, 0::BIGINT AS label FROM eval_items WHERE passage IS NOT NULL UNION ALL SELECT item_id, text, 1 FROM eval_items WHERE text IS NOT NULL)")
def j12_wide_to_long(spark, d):
    e = table(spark, d, "eval_items", "item_id", "passage", "text").withColumnRenamed("text", "whole")
    return corpus.wide_to_long(e, "item_id", "passage", "whole").withColumnRenamed("item_id", "doc_id")


@query("SELECT item_id, (unnest(range(len(a))))::BIGINT AS place, unnest(a) AS text, label FROM (SELECT item_id, string_split(passage, '. ') AS a, 0::BIGINT AS label FROM eval_items UNION ALL SELECT item_id, string_split(text, chr(10)), 1 FROM eval_items)")
def j13_answers_to_rows(spark, d):
    e = table(spark, d, "eval_items", "item_id", "passage", "text").select("item_id", F.split("passage", r"\. ").alias("human_answers"), F.split("text", "\n").alias("machine_answers"))
    return corpus.answers_to_rows(e, "item_id", "human_answers", "machine_answers")


# ---- samples -------------------------------------------------------------------------------------------------------
RANK = "row_number() OVER (PARTITION BY {by} ORDER BY md5(row_id::VARCHAR || '-42'), row_id)"
LABELLED = "SELECT row_id, lower(trim(register)) AS register, label, length(text) AS n_chars FROM corpus_raw WHERE register IS NOT NULL AND label IS NOT NULL AND text IS NOT NULL"


def labelled(spark, d):
    return table(spark, d, "corpus_raw", "row_id", "register", "label", "text").dropna().select("row_id", F.lower(F.trim("register")).alias("register"), "label", F.length("text").alias("n_chars"))


@query(f"SELECT row_id, register, label::BIGINT AS label FROM (SELECT *, {RANK.format(by='register, label')} AS r FROM ({LABELLED})) WHERE r <= 100")
def r1_capped(spark, d):
    return sampling.capped(labelled(spark, d), ["register", "label"], "row_id", 100).select("row_id", "register", "label")


@query(f"WITH l AS ({LABELLED}), c AS (SELECT register, least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1), 5000) AS n FROM l GROUP BY 1), k AS (SELECT *, {RANK.format(by='register, label')} AS r FROM l) SELECT row_id, register, label::BIGINT AS label FROM k JOIN c USING (register) WHERE r <= n")
def r3_equal_sizes(spark, d):
    return sampling.equal_sizes(labelled(spark, d), "register", "label", "row_id", 5000).select("row_id", "register", "label")


@query(
    f"""WITH l AS ({LABELLED}), e AS (SELECT register, list_sort(list_distinct(quantile_cont(n_chars::DOUBLE, [{', '.join(str(i / 20) for i in range(21))}]))) AS edges FROM l GROUP BY 1),
    b AS (SELECT l.*, len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda x: x <= n_chars)) AS bin FROM l JOIN e USING (register)),
    c AS (SELECT register, bin, least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1)) AS n FROM b GROUP BY ALL HAVING n >= 5), k AS (SELECT *, {RANK.format(by='register, bin, label')} AS r FROM b)
    SELECT row_id, register, label::BIGINT AS label, bin::BIGINT AS bin FROM k JOIN c USING (register, bin) WHERE r <= n"""
)
def r5_length_matched(spark, d):
    return sampling.length_matched(labelled(spark, d), "register", "label", "n_chars", "row_id").select("row_id", "register", "label", "bin")


@query(f"SELECT row_id, (({RANK.format(by='label')} - 1) % 5)::BIGINT AS fold FROM ({LABELLED})")
def r7_folds(spark, d):
    return sampling.folds(labelled(spark, d), ["label"], "row_id").select("row_id", "fold")


@query(f"SELECT row_id, {RANK.format(by='register, label')} <= floor(count(*) OVER (PARTITION BY register, label) * 0.3) AS is_test FROM ({LABELLED})")
def r8_split(spark, d):
    return sampling.split(labelled(spark, d), ["register", "label"], "row_id", 0.3).select("row_id", "is_test")


@query(f"WITH l AS ({LABELLED}), n AS (SELECT register, greatest(0, 1500 - count(*) FILTER (WHERE label = 0)) AS need FROM l GROUP BY 1), k AS (SELECT *, {RANK.format(by='register')} AS r FROM l WHERE label = 1) SELECT row_id, register FROM k JOIN n USING (register) WHERE r <= need")
def r9_quota(spark, d):
    c = labelled(spark, d)
    have = c.groupBy("register").agg(F.count(F.when(F.col("label") == 0, 1)).alias("n"))
    return corpus.quota(c.filter("label = 1"), "register", "row_id", have, 1500).select("row_id", "register")


# ---- windows over sentences ----------------------------------------------------------------------------------------
def sentence_scores(spark, d):
    """Sentences with a fixed score, null for those of fewer than four words: a stand-in for a model's, as the operators take any."""
    s = windows.sentence_rows(documents(spark, d), "doc_id")
    return s.select("doc_id", "idx", F.when(F.size(X.space_words("sentence")) >= 4, (F.length("sentence") % 17) / 16.0).alias("score"))


SENTENCES = f"sent AS (SELECT doc_id, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM {DOCS})), sc AS (SELECT doc_id, idx, CASE WHEN len({space_words_sql('sentence')}) >= 4 THEN (length(sentence) % 17) / 16.0 END AS score FROM sent)"


@query(f"WITH {SENTENCES}, j AS (SELECT doc_id, idx, string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS win FROM sent) SELECT doc_id, idx::BIGINT AS idx, CASE WHEN len({space_words_sql('win')}) >= 15 THEN win END AS \"window\" FROM j")
def w1_centred_windows(spark, d):
    return windows.centred_windows(windows.sentence_rows(documents(spark, d), "doc_id"), "doc_id").select("doc_id", "idx", "window")


@query(f"WITH {SENTENCES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sc), w AS (SELECT *, greatest(0, least(idx - 1, n - 3)) AS st FROM n), m AS (SELECT doc_id, score, unnest(range(st, least(st + 3, n))) AS member FROM w) SELECT doc_id, member::BIGINT AS idx, round(avg(score), 6)::DOUBLE AS mean_score FROM m GROUP BY 1, 2")
def w2_shifted_windows(spark, d):
    return windows.shifted_window_means(sentence_scores(spark, d), "doc_id", "score")


@query(
    f"""WITH {SENTENCES}, e AS (SELECT *, last_value(score IGNORE NULLS) OVER p AS l, first_value(score IGNORE NULLS) OVER f AS r, last_value(CASE WHEN score IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS li, first_value(CASE WHEN score IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS ri FROM sc
    WINDOW p AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT doc_id, idx::BIGINT AS idx, round(coalesce(score, l + (idx - li) / nullif(ri - li, 0) * (r - l), l, r), 6)::DOUBLE AS filled FROM e"""
)
def w4_interpolated(spark, d):
    return windows.interpolated(sentence_scores(spark, d), "doc_id", "score").select("doc_id", "idx", "filled")


@query(f"WITH {SENTENCES}, v AS (SELECT doc_id, idx, round(score - lag(score) OVER (PARTITION BY doc_id ORDER BY idx), 9) AS delta FROM sc WHERE score IS NOT NULL) SELECT doc_id, idx::BIGINT AS idx, CASE WHEN delta > 0 THEN 'human_to_ai' ELSE 'ai_to_human' END AS direction, round(abs(delta), 6)::DOUBLE AS delta FROM v WHERE abs(delta) >= 0.25")
def w5_transitions(spark, d):
    return windows.transitions(sentence_scores(spark, d), "doc_id", "score")


@query(f"WITH {SENTENCES}, g AS (SELECT doc_id, count(*)::BIGINT AS sentences, count(*) FILTER (WHERE score >= 0.5)::BIGINT AS ai, count(*) FILTER (WHERE score > 0.35 AND score < 0.65)::BIGINT AS uncertain, count(*) FILTER (WHERE score < 0.5)::BIGINT AS human, round(coalesce(avg(score), 0.5), 6)::DOUBLE AS mean_score FROM sc GROUP BY 1) SELECT *, ai > 0 AND human > 0 AS mixed FROM g")
def w6_spans(spark, d):
    return windows.spans(sentence_scores(spark, d), "doc_id", "score")


# ---- perturbation, watermark ---------------------------------------------------------------------------------------
def gate_sql(key: str, rate: float) -> str:
    return f"('0x' || substr(md5({key}), 1, 4))::INTEGER < {int(65536 * rate)}"


def stop_sentences_sql(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def capital_sql(x: str) -> str:
    return f"upper(left({x}, 1)) || substr({x}, 2)"


OPENING = "(?i)^(?:" + "|".join(sorted(L.CONNECTORS, key=len, reverse=True)) + ")[ ,]+"


@query(
    f"""WITH s AS (SELECT doc_id, {stop_sentences_sql('text')} AS s FROM {DOCS}),
    c AS (SELECT doc_id, list_transform(s, lambda x: {{'x': x, 'c': regexp_replace(x, '{OPENING}', '')}}) AS s FROM s)
    SELECT doc_id, array_to_string(list_transform(s, lambda p:
      CASE WHEN p.x = p.c THEN p.x ELSE {capital_sql(strip_sql('p.c'))} END), ' ') AS text FROM c"""
)
def h1_without_connectors(spark, d):
    return documents(spark, d).select("doc_id", perturb.without_connectors("text").alias("text"))


def _synonyms_sql(rate: float) -> str:
    new = "CASE regexp_replace(lower(t), '^[.,;:!?]+|[.,;:!?]+$', '', 'g') "
    new += " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SYNONYMS.items()) + " END"
    cased = rf"CASE WHEN regexp_matches(left(t, 1), '\p{{Lu}}') THEN {capital_sql(new)} ELSE {new} END"
    gate = gate_sql("t || '-' || (i - 1)", rate)
    swap = f"list_transform(w, lambda t, i: coalesce(CASE WHEN {gate} THEN {cased} END, t))"
    return f"WITH a AS (SELECT doc_id, {space_words_sql('text')} AS w FROM {DOCS}) SELECT doc_id, array_to_string({swap}, ' ') AS text FROM a"


@query(_synonyms_sql(perturb.SWAP_RATE))
def h2_synonyms(spark, d):
    return documents(spark, d).select("doc_id", perturb.swapped("text").alias("text"))


@query()
def h3_varied_lengths(spark, d):
    return documents(spark, d).select("doc_id", perturb.varied("text").alias("text"))


def _repunctuated_sql() -> str:
    gates = [gate_sql(f"'{k}-' || text", r) for k, r in (("c", perturb.SEMICOLON_RATE), ("e", perturb.EXCLAMATION_RATE), ("q", perturb.QUESTION_RATE))]
    return f"""WITH c AS (SELECT doc_id, text, CASE WHEN {gates[0]} THEN replace(text, ', ', '; ') ELSE text END AS a FROM {DOCS}),
    e AS (SELECT doc_id, text, CASE WHEN {gates[1]} THEN replace(a, '. ', '! ') ELSE a END AS a FROM c)
    SELECT doc_id, CASE WHEN {gates[2]} AND contains(a, '. ')
      THEN left(a, instr(a, '. ') - 1) || '? ' || substr(a, instr(a, '. ') + 2) ELSE a END AS text FROM e"""


@query(_repunctuated_sql())
def h4_repunctuated(spark, d):
    return documents(spark, d).select("doc_id", perturb.repunctuated("text").alias("text"))


def _first_person_sql() -> str:
    gate = gate_sql("p.x || '-' || p.i", perturb.PRONOUN_RATE)
    return f"""WITH s AS (SELECT doc_id, {stop_sentences_sql('text')} AS s FROM {DOCS}),
    c AS (SELECT doc_id, list_transform(s, lambda x, i: {{'x': x, 'i': i - 1, 'w': {space_words_sql('x')}}}) AS s FROM s)
    SELECT doc_id, array_to_string(list_transform(s, lambda p: CASE WHEN len(p.w) > 3 AND {gate}
      THEN array_to_string(list_concat(list_append(p.w[1:3], 'I'), p.w[4:]), ' ') ELSE p.x END), ' ') AS text FROM c"""


@query(_first_person_sql())
def h5_in_first_person(spark, d):
    return documents(spark, d).select("doc_id", perturb.in_first_person("text").alias("text"))


@query()
def h6_humanized(spark, d):
    return documents(spark, d).select("doc_id", perturb.humanized("text").alias("text"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, len(t) AS n, list_transform(t, lambda w: md5('42:' || w)) AS m FROM t),
    g AS (SELECT doc_id, n, len(list_filter(m, lambda x: ((((('0x' || x[1:8])::BIGINT % 100) * 96 + ('0x' || x[9:16])::BIGINT) % 100 * 96 + ('0x' || x[17:24])::BIGINT) % 100 * 96 + ('0x' || x[25:32])::BIGINT) % 100 < 50)) AS green FROM h),
    z AS (SELECT doc_id, n, green, CASE WHEN n >= 20 THEN (green - 0.5 * n) / sqrt(n * 0.25) END AS z FROM g)
    SELECT doc_id, n::BIGINT AS tokens, green::BIGINT AS green, round(z, 6)::DOUBLE AS z, CASE WHEN z >= 6 THEN 'high' WHEN z >= 4 THEN 'medium' WHEN z >= 2.4 THEN 'low' ELSE 'none' END AS confidence FROM z"""
)
def m14_watermark(spark, d):
    return scoring.watermark(documents(spark, d), "doc_id")


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(t) AS tokens, CASE WHEN len(t) >= 20 THEN list_entropy(t) END AS h FROM t)
    SELECT doc_id, tokens::BIGINT AS tokens, round(h, 6)::DOUBLE AS entropy, CASE WHEN tokens < 20 THEN 'insufficient_length' WHEN h > 7.0 THEN 'possible' WHEN h > 6.5 THEN 'elevated' ELSE 'normal' END AS finding FROM e"""
)
def m15_blind_watermark(spark, d):
    return scoring.blind_watermark(documents(spark, d), "doc_id")
