"""Queries of this subpackage over the whole tables of a data directory, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import abuse, collapse, cube, cutoff, leak, level, lookalike, mixing, neardup
from lectern.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among rows of at least 20 words, each with the row kept for it."""
    return collapse.copies_found(table(spark, sf_dir, "corpus_raw", "row_id", "text"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content of the corpus, with its number of copies."""
    return collapse.copy_counts(table(spark, sf_dir, "corpus_raw", "row_id", "text"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Runs of three words; true cases lie above 0.65 and others at 0.5 or below, so the threshold is between.
    return neardup.near_duplicates(table(spark, sf_dir, "corpus_raw", "row_id", "text"), k=3, threshold=0.6, least_words=20)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that are versions of one text."""
    return neardup.expanded(*_versions(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each row that has versions, the group's size and models, and the row's links."""
    models = table(spark, sf_dir, "corpus_raw").select(F.col("row_id").alias("id"), F.nullif(F.lower(F.trim("model")), F.lit("")).alias("model"))
    return neardup.groups(*_versions(spark, sf_dir), models)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose text looks like a corpus text and differs from it in characters."""
    return lookalike.alike(table(spark, sf_dir, "corpus_raw", "row_id", "text"), table(spark, sf_dir, "detect_request", "request_id", "text"), "row_id", "request_id")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of every corpus text and request, by its hash, and whether it differs from the text."""
    tabs = {"corpus_raw": "row_id", "detect_request": "request_id"}
    rows = None
    for tab, key in tabs.items():
        one = table(spark, sf_dir, tab).select(F.struct(F.lit(tab).alias("tab"), F.col(key).alias("rec_id"), F.sha2("text", 256).alias("was")).alias("rec"), "text")
        rows = one if rows is None else rows.unionAll(one)
    form = lookalike.form_hashes(rows, "rec", "text").select("id.*", "form")
    return form.select("tab", "rec_id", "form", (F.col("form") != F.col("was")).alias("changed"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, whole or in part."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def _p7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs, table(spark, sf_dir, "eval_items", "item_id", "passage")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the longest leaked stretch in words and its share of the passage."""
    return leak.leaked_items(*_p7(spark, sf_dir))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the documents the leaked stretches stand, in words and characters."""
    return leak.leaked_spans(*_p7(spark, sf_dir)).drop("words").distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked spans: the new text by its hash and length, and what was removed."""
    clean = leak.cleaned(*_p7(spark, sf_dir))
    return clean.select("doc_id", F.sha2("text", 256).alias("text_sha"), F.length("text").alias("n_chars"), "removed_words", "whole")


P1_TABS = ("corpus_raw", "error_examples")


def _p1_tabs(spark: SparkSession, sf_dir: str) -> list:
    keys = {"corpus_raw": "row_id", "error_examples": "example_id"}
    return [(i, table(spark, sf_dir, t, keys[t], "source", "text"), keys[t]) for i, t in enumerate(P1_TABS)]


def _tab_name():
    return F.element_at(F.array(*map(F.lit, P1_TABS)), F.col("tab") + 1).alias("tab")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text was cut by a limit of length or a broken transfer."""
    return cutoff.cut_records(_p1_tabs(spark, sf_dir)).select(_tab_name(), F.col("id").alias("rec_id"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source of each table cuts."""
    return cutoff.cut_rates(_p1_tabs(spark, sf_dir)).withColumn("tab", _tab_name())


def _sample(spark: SparkSession, sf_dir: str) -> cube.CubeSample:
    return cube.CubeSample(table(spark, sf_dir, "corpus_raw", "row_id", "text", "register", "label", "model"), table(spark, sf_dir, "sample_targets"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with fewer rows than their target."""
    return _sample(spark, sf_dir).report().filter("short").select("cell_id")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, available and sampled rows of each cell, with the residual imbalance."""
    return _sample(spark, sf_dir).report()


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's rows with their cells."""
    return _sample(spark, sf_dir).rows.select(F.col("id").alias("row_id"), "cell_id")


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "register"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sources that fall short of their share."""
    return _mix(spark, sf_dir).report().filter("short").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual tokens and shares of each listed source."""
    return _mix(spark, sf_dir).report()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, sf_dir).docs


def _levels(spark: SparkSession, sf_dir: str, least_words: int) -> DataFrame:
    return level.graded(table(spark, sf_dir, "corpus_raw", "row_id", "text", "register", "source"), least_words=least_words)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of at least 20 words that are easy or hard to read."""
    return _levels(spark, sf_dir, 20).filter("band <> 'middle'").select(F.col("id").alias("row_id"), "band").distinct()


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading levels by register."""
    return level.profile(_levels(spark, sf_dir, 1))


def p2_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated errors of the calibrated grades, whole sources held out."""
    return level.cross_validated(table(spark, sf_dir, "corpus_raw", "row_id", "text", "source"), "row_id", "text", "source")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return abuse.scored(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "toxicity_labels", "doc_id", "toxic"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit passages."""
    return p9_scores(spark, sf_dir).filter("score >= 0.5").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of such documents by source."""
    return abuse.rates(p9_scores(spark, sf_dir))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p2_found": p2_found, "p2_profile": p2_profile, "p2_cv": p2_cv, "p5_found": p5_found, "p5_report": p5_report, "p5_sample": p5_sample, "p8_found": p8_found, "p8_shares": p8_shares, "p8_mix": p8_mix, "p1_found": p1_found, "p1_rates": p1_rates, "p6_found": p6_found, "p6_forms": p6_forms, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_spans": p7_spans, "p7_clean": p7_clean, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_copies": p4_copies}
#: White space as Unicode has it.
_SPACE = r"[\s\x0b\p{Z}\x{85}\x{1c}-\x{1f}]"
_LONG = rf"len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')) >= 20"

def _bare(x: str) -> str:
    """A text without white space, case and punctuation."""
    return rf"regexp_replace(lower({x}), '[\s\x0b\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}\p{{P}}$+<=>^`|~]', '', 'g')"


def _copies(least: str) -> str:
    """``kept``: the row kept for each row, by equal texts and by equal named fields, sorted, where there are two."""
    named = r"\s*[;\n]\s*([\p{L}_][\p{L}\p{N}_]{0,30}\s*[:=])"
    return rf"""
        WITH t AS (SELECT row_id, text, {_bare("text")} AS k FROM corpus_raw WHERE text IS NOT NULL AND {least}),
        heads AS (SELECT *, min(row_id) OVER (PARTITION BY k) AS head FROM t),
        parts AS (SELECT head, CASE WHEN starts_with(ltrim(text), '{{') THEN
            CASE WHEN json_valid(text) THEN
              list_transform(json_keys(text), lambda x: x || json_extract_string(text, '$."' || x || '"')) END
          WHEN regexp_matches(ltrim(text), '^[\p{{L}}\p{{N}}]+ ?[:=]')
            THEN string_split(regexp_replace(text, '{named}', chr(1) || '\1', 'g'), chr(1)) END AS p FROM heads),
        keys AS (SELECT head, array_to_string(list_sort(list_transform(p, lambda x: {_bare("x")})), chr(1)) AS f
          FROM parts WHERE len(p) >= 2),
        merged AS (SELECT head, min(other) AS merged
          FROM (SELECT head, min(head) OVER (PARTITION BY f) AS other FROM keys) GROUP BY 1),
        kept AS (SELECT row_id, coalesce(merged, head) AS keep_id FROM heads LEFT JOIN merged USING (head))
    """


SQL: dict[str, str] = {
    "p4_found": _copies(_LONG) + "SELECT DISTINCT keep_id, row_id FROM kept WHERE keep_id <> row_id",
    "p4_copies": _copies("true") + "SELECT keep_id, count(*) AS copies FROM kept GROUP BY 1",
    "p3_found": rf"""
        WITH w AS (SELECT row_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM corpus_raw WHERE text IS NOT NULL AND {_LONG}),
        r AS (SELECT row_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS runs FROM w WHERE len(w) >= 3),
        u AS (SELECT row_id, len(runs) AS n, unnest(runs) AS run FROM r)
        SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM u a JOIN u b ON a.run = b.run AND a.row_id < b.row_id
        GROUP BY a.row_id, b.row_id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))
    """,
    "p5_found": """
        WITH rows AS (SELECT lower(trim(register)) AS register, label, lower(trim(model)) AS model FROM corpus_raw WHERE text IS NOT NULL),
        size AS (SELECT count(*) // 5 AS n FROM rows),
        have AS (SELECT t.cell_id, count(r.register) AS available FROM sample_targets t LEFT JOIN rows r ON r.register = lower(trim(t.register)) AND r.label = t.label AND r.model = lower(trim(t.model)) GROUP BY 1)
        SELECT cell_id FROM sample_targets JOIN have USING (cell_id), size WHERE available < greatest(min_rows, floor(target_share * n))
    """,
    # Words stand for tokens: no source is close to its limit.
    "p8_found": rf"""
        WITH have AS (SELECT t.source, t.weight, t.max_repeats, coalesce(sum(len(regexp_extract_all(d.text, '[\p{{L}}\p{{N}}]+'))), 0) AS n
          FROM mix_targets t LEFT JOIN documents d ON d.source = t.source GROUP BY 1, 2, 3)
        SELECT source FROM have WHERE n * max_repeats < weight * (SELECT sum(n) FROM have)
    """,
}
