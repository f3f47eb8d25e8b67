"""Queries over models by register, comparisons of models, shapes of tables, checks of requests, and SQL names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import SCORES, documents, query, scores, spread, table
from lectern.functions import kernel
from lectern.functions import register as names
from lectern.functions import text as X
from lectern.functions import wordlists as L
from lectern.operators import corpus, modeling, perturb, running, sampling, scoring, shape, stats, training
from lectern.plans import detect
from lectern.plans.queries_scores import CELLS, CURVE, PR, threshold_cells
from lectern.plans.queries_text import DOCS, STYLE, q, sentences_sql, space_words_sql, strip_sql
from lectern.plans.stage import written

SIGNALS = ["stylometric_score", "binoculars_score", "binoculars_score_neg"]


# ---- statistics ----------------------------------------------------------------------------------------------------
@query("SELECT feature, round(avg(abs(cohens_d)), 6)::DOUBLE AS mean FROM effect_sizes GROUP BY 1 ORDER BY avg(abs(cohens_d)) DESC NULLS LAST, feature LIMIT 20")
def a21_top_importance(spark, d):
    """The features with the highest mean importance over registers, the importance being the size of the effect."""
    return shape.top_mean(table(spark, d, "effect_sizes", "feature", "cohens_d"), "feature", F.abs("cohens_d"))


def _family_sql() -> str:
    tests = [(g, " OR ".join(f"contains(lower(model), {q(k)})" for k in keys)) for g, keys in L.MODEL_GROUPS]
    return f"CASE WHEN model IS NULL THEN 'human' {' '.join(f'WHEN {t} THEN {q(g)}' for g, t in tests)} ELSE 'other' END"


GROUPS = _family_sql()


def _by_detector_sql() -> str:
    return f"""WITH {SCORES}, j AS (SELECT s.*, {GROUPS} AS family FROM s JOIN corpus_raw USING (row_id)),
    long AS (SELECT row_id, label, family, detector, score FROM j UNPIVOT (score FOR detector IN ({', '.join(SIGNALS)}))),
    ai AS (SELECT DISTINCT detector, family FROM long WHERE label = 1),
    u AS (SELECT detector, family, 1 AS y, score FROM long WHERE label = 1
      UNION ALL SELECT ai.detector, ai.family, 0, l.score FROM ai JOIN long l ON l.detector = ai.detector AND l.label = 0),
    k AS (SELECT detector, family, y, rank() OVER (PARTITION BY detector, family ORDER BY score)
      + (count(*) OVER (PARTITION BY detector, family, score) - 1) / 2.0 AS r FROM u),
    a AS (SELECT detector, family, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, sum(r) FILTER (WHERE y = 1) AS r1 FROM k GROUP BY 1, 2),
    c AS (SELECT detector, family, (r1 - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0) AS auc FROM a)
    SELECT family, {', '.join(f"round(max(auc) FILTER (WHERE detector = '{s}'), 6)::DOUBLE AS {s}" for s in SIGNALS)} FROM c GROUP BY 1"""


@query(_by_detector_sql())
def a22_family_by_detector(spark, d):
    """AUC of each detector on each family of models against all humans, as a table with a column for each detector.

    Humans are counted by score once; only those counts meet the families, of which there are few.
    """
    families = table(spark, d, "corpus_raw", "row_id", corpus.model_group(F.col("model")).alias("family"))
    rows = scores(spark, d).join(families, "row_id")
    long = rows.unpivot(["label", "family"], SIGNALS, "detector", "score").filter("score is not null")
    counts = written(long.groupBy("detector", "family", "label", "score").agg(F.count(F.lit(1)).alias("n")))
    ai = counts.filter("label = 1")
    human = counts.filter("label = 0").groupBy("detector", "score").agg(F.sum("n").alias("n"))
    pairs = F.broadcast(ai.select("detector", "family").distinct())
    both = ai.select("detector", "family", "score", F.col("n").alias("pos"), F.lit(0).cast("long").alias("neg"))
    against = human.join(pairs, "detector").select("detector", "family", "score", F.lit(0).cast("long").alias("pos"), F.col("n").alias("neg"))
    keys = ["detector", "family"]
    c = both.unionAll(against).groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    c = running.running_sums(c, keys, [F.col("score")], ["neg"])
    u = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    auc = c.groupBy(*keys).agg((u / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    return auc.groupBy("family").pivot("detector", SIGNALS).agg(F.first("auc"))


def _invariance_sql() -> str:
    one = lambda s: f"""SELECT '{s}' AS features, a.register AS train, b.register AS test, avg(CASE WHEN (b.{s} - a.mid >= 0) = (b.label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM (SELECT register, median({s}) AS mid FROM s GROUP BY 1) a, s b WHERE b.{s} IS NOT NULL AND a.mid IS NOT NULL GROUP BY ALL"""  # noqa: E731
    return f"WITH {SCORES}, cells AS ({' UNION ALL '.join(map(one, SIGNALS))}) SELECT features, round(avg(accuracy), 6)::DOUBLE AS invariance FROM cells WHERE train <> test GROUP BY 1"


@query(_invariance_sql())
def a34_domain_invariance(spark, d):
    """The mean accuracy off the diagonal of each score: thresholds at one register's median, tried on the others."""
    s = scores(spark, d)
    out = None
    for c in SIGNALS:
        mids = running.quantiles(s, ["register"], c, [0.5]).select(F.col("register").alias("train"), F.get("values", 0).alias("mid"))
        # One row a register on the left.
        cells = s.filter(F.col(c).isNotNull()).withColumnRenamed("register", "test").crossJoin(F.broadcast(mids))
        right = ((F.col(c) - F.col("mid") >= 0) == (F.col("label") == 1)).cast("double")
        by_cell = cells.groupBy("train", "test").agg(F.avg(right).alias("accuracy")).filter("train <> test")
        part = by_cell.agg(F.avg("accuracy").alias("invariance")).select(F.lit(c).alias("features"), "invariance")
        out = part if out is None else out.unionAll(part)
    return out


@query()
def a16_detection_rates(spark, d):
    """Share of rewritten machine texts found at the threshold with 90 % recall on texts as they are."""
    docs = documents(spark, d, "label").filter("label in (0, 1)")
    out = docs.select("label", F.lit("none").alias("attack"), "text")
    for name in perturb.STRATEGIES:
        out = out.unionAll(docs.filter("label = 1").select("label", F.lit(name).alias("attack"), perturb.humanized("text", name).alias("text")))
    scored = detect.default_scorer(kernel.with_features(out, columns=list(detect.WEIGHTS)))
    return stats.detection_rates(written(scored.select("label", "attack", "p")), "attack", "p", "label")


RATIOS = (1, 10, 100, 1000)


def _ratio_pivot_sql() -> str:
    share = "(1.0 / (ratio + 1))"
    return f"""WITH {PR}, x AS (SELECT register, unnest([1, 10, 100, 1000]) AS ratio, recall, fp / nullif(n_neg, 0) AS fpr FROM b WHERE k = 1 AND target = 0.9),
    y AS (SELECT register, ratio, recall * {share} / nullif(recall * {share} + fpr * (1 - {share}), 0) AS p FROM x)
    SELECT register, {', '.join(f"round(coalesce(max(p) FILTER (WHERE ratio = {r}), 0), 6)::DOUBLE AS r{r}" for r in RATIOS)} FROM y GROUP BY 1"""


@query(_ratio_pivot_sql())
def a23_precision_by_ratio(spark, d):
    """Deployment precision of each register, a column for each ratio, 0 where there is none."""
    p = stats.at_deployment(scores(spark, d), ["register"], "stylometric_score", "label")
    wide = p.groupBy("register").pivot("ratio", list(RATIOS)).agg(F.first("deployment_precision"))
    return wide.select("register", *(F.coalesce(F.col(str(r)), F.lit(0.0)).alias(f"r{r}") for r in RATIOS))


HEAT = ["academic", "creative", "encyclopedic", "news", "social"]


@query(
    f"WITH {CELLS} SELECT train, {', '.join(f'round(max(accuracy) FILTER (WHERE test = {q(r)}), 6)::DOUBLE AS {r}' for r in HEAT)} FROM cells GROUP BY 1"
)
def a23_train_by_test(spark, d):
    """Accuracy of each register's threshold, a column for each register it is tried on."""
    return threshold_cells(spark, d).groupBy("train").pivot("test", HEAT).agg(F.first("accuracy"))


@query(
    f"""WITH {CURVE}, u AS (SELECT register, sum(pos * (below + neg / 2.0)) / nullif(n_pos * n_neg, 0) AS auc FROM r GROUP BY register, n_pos, n_neg),
    e AS (SELECT register, count(*) FILTER (WHERE label = 0 AND stylometric_score >= 0.5) / nullif(count(*) FILTER (WHERE label = 0), 0) AS fp,
      count(*) FILTER (WHERE label = 1 AND stylometric_score < 0.5) / nullif(count(*) FILTER (WHERE label = 1), 0) AS fn FROM s WHERE stylometric_score IS NOT NULL GROUP BY 1)
    SELECT register, round(fp, 6)::DOUBLE AS fp_rate, round(fn, 6)::DOUBLE AS fn_rate, round(auc, 6)::DOUBLE AS auc FROM e LEFT JOIN u USING (register)"""
)
def a27_error_rates(spark, d):
    """Error rates at 0.5 and AUC of each register."""
    s = scores(spark, d)
    rates = stats.confusion(s, ["register"], "stylometric_score", "label").select("register", "fp_rate", "fn_rate")
    auc = stats.auc(s, ["register"], "stylometric_score", "label").select("register", "auc")
    return rates.join(auc, "register", "left")


@query(
    f"""WITH {SCORES}, e AS (SELECT row_id, register, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS error_type, stylometric_score AS score FROM s
      WHERE (label = 0 AND stylometric_score >= 0.5) OR (label = 1 AND stylometric_score < 0.5)),
    k AS (SELECT *, row_number() OVER (PARTITION BY register, error_type ORDER BY md5(row_id::VARCHAR || '-42'), row_id) AS k FROM e)
    SELECT row_id, k.register, error_type, round(score, 6)::DOUBLE AS score, left(text, 100) AS head FROM k LEFT JOIN corpus_raw USING (row_id) WHERE k <= 3"""
)
def j5_error_texts(spark, d):
    """Texts of at most three errors a register and kind, fetched by their ids after the sample is drawn."""
    s = scores(spark, d)
    hit, y = F.col("stylometric_score") >= 0.5, F.col("label")
    wrong = s.filter((hit & (y == 0)) | (~hit & (y == 1))).withColumn("error_type", F.when(y == 0, "FP").otherwise("FN"))
    some = sampling.capped(wrong, ["register", "error_type"], "row_id", 3)
    texts = table(spark, d, "corpus_raw", "row_id", "text")
    # At most three rows a register and kind.
    joined = F.broadcast(some).join(texts.join(F.broadcast(some.select("row_id")), "row_id", "left_semi"), "row_id", "left")
    return joined.select("row_id", "register", "error_type", F.col("stylometric_score").alias("score"), F.substring("text", 1, 100).alias("head"))


# ---- shapes and checks ---------------------------------------------------------------------------------------------
@query(
    """SELECT row_id, CASE WHEN model IS NULL THEN NULL WHEN lower(trim(model)) IN ('human', '0', '0.0') THEN 0 ELSE 1 END::BIGINT AS plain,
    (1 - label)::BIGINT AS flipped, CASE WHEN model IS NULL THEN NULL WHEN lower(trim(model)) = 'human' THEN 0 ELSE 1 END::BIGINT AS named,
    CASE WHEN model IS NULL THEN NULL WHEN lower(trim(model)) IN ('1', '1.0', 'ai', 'machine') THEN 1 ELSE 0 END::BIGINT AS lenient FROM corpus_raw"""
)
def f11_labels(spark, d):
    c = table(spark, d, "corpus_raw", "row_id", "model", "label")
    of = lambda column, scheme: shape.label_of(F.col(column), scheme).alias(scheme)
    return c.select("row_id", of("model", "plain"), of("label", "flipped"), of("model", "named"), of("model", "lenient"))


@query(
    f"""SELECT request_id, CASE WHEN text IS NULL OR {strip_sql('text')} = '' THEN 'no text' WHEN length(text) > 10000 THEN 'text over 10000 characters'
    WHEN len({space_words_sql('text')}) < 30 THEN 'text under 30 words' WHEN coalesce(lower(trim(register)), 'all') NOT IN ('academic', 'news', 'social', 'creative', 'encyclopedic', 'all') THEN 'unknown register' END AS error FROM detect_request"""
)
def f13_checked_requests(spark, d):
    r = table(spark, d, "detect_request", "request_id", "text", "register")
    return shape.checked_requests(r).select("request_id", "error")


@query("SELECT client_id, count(*)::BIGINT AS requests FROM detect_request GROUP BY 1 HAVING count(*) > 100")
def f13_large_batches(spark, d):
    return shape.batch_too_large(table(spark, d, "detect_request", "client_id"), "client_id", 100)


@query("SELECT row_id, model FROM (SELECT row_id, model, row_number() OVER (PARTITION BY model ORDER BY row_id) AS k FROM corpus_raw) WHERE k <= 50")
def w11_head_of_each(spark, d):
    return shape.head_of_each(table(spark, d, "corpus_raw", "row_id", "model"), "model", ["row_id"], 50)


@query(
    """WITH t AS (SELECT row_id, label, coalesce(source, 'none') AS attack FROM corpus_raw), s AS (SELECT *, CASE WHEN label = 1 THEN '1' || attack WHEN attack = 'none' THEN '0' END AS side FROM t),
    k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY row_id) AS k FROM s WHERE side IS NOT NULL) SELECT row_id, attack, label::BIGINT AS label FROM k WHERE k <= CASE WHEN side = '0' THEN 1000 ELSE 500 END"""
)
def r10_attack_quota(spark, d):
    """The source stands for the attack; no source is none."""
    c = table(spark, d, "corpus_raw", "row_id", F.coalesce("source", F.lit("none")).alias("attack"), "label")
    return shape.attack_quota(c, "attack", "label", ["row_id"])


@query(
    """WITH a AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS k FROM corpus_raw), b AS (SELECT example_id, row_number() OVER (ORDER BY example_id, run_at) AS k FROM error_examples)
    SELECT row_id, example_id FROM a JOIN b USING (k)"""
)
def j6_zipped(spark, d):
    left = table(spark, d, "corpus_raw", "row_id")
    right = table(spark, d, "error_examples", "example_id", "run_at")
    return shape.zipped(left, ["row_id"], right, ["example_id", "run_at"]).select("row_id", "example_id")


@query("SELECT source FROM corpus_raw WHERE source IS NOT NULL UNION SELECT source FROM documents WHERE source IS NOT NULL UNION SELECT source FROM error_examples WHERE source IS NOT NULL")
def o9_key_union(spark, d):
    return shape.key_union([table(spark, d, t, "source") for t in ("corpus_raw", "documents", "error_examples")], "source")


@query(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + ", ".join(f"round(max({c}) FILTER (WHERE register = '{r}'), 6)::DOUBLE AS {r}" for r in ("academic", "creative", "news", "social"))
        + " FROM effect_sizes WHERE feature = 'mtld'" for c in ("human_mean", "ai_mean", "cohens_d")
    ) + ")"
)
def o12_transposed(spark, d):
    registers = ["academic", "creative", "news", "social"]
    e = table(spark, d, "effect_sizes", "register", "feature", "human_mean", "ai_mean", "cohens_d").filter("feature = 'mtld'")
    return shape.transposed(e.filter(F.col("register").isin(registers)), "register", ["human_mean", "ai_mean", "cohens_d"])


WANTED = ["news", "poetry", "academic", "social"]


@query(
    "SELECT w.place::BIGINT AS place, w.register, n::BIGINT AS n FROM (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(WANTED))
    + ") w(place, register) LEFT JOIN (SELECT lower(trim(register)) AS register, count(*) AS n FROM corpus_raw GROUP BY 1) c USING (register)"
)
def o13_reindexed(spark, d):
    c = table(spark, d, "corpus_raw", F.lower(F.trim("register")).alias("register"))
    return shape.reindexed(c.groupBy("register").agg(F.count(F.lit(1)).alias("n")), "register", WANTED)


@query("SELECT row_id, (row_number() OVER (ORDER BY md5(row_id::VARCHAR || '-42'), row_id))::BIGINT AS place FROM corpus_raw")
def o14_shuffled(spark, d):
    """Each row's place in a fixed pseudo-random order."""
    return sampling.ranked(table(spark, d, "corpus_raw", "row_id"), [], "row_id").withColumnRenamed("_rank", "place")


@query("SELECT row_id FROM corpus_raw ORDER BY md5(row_id::VARCHAR || '-42'), row_id LIMIT 500")
def r2_sample(spark, d):
    return sampling.sample(table(spark, d, "corpus_raw", "row_id"), "row_id", 500)


def _shown_sql(x: str) -> str:
    return f"CASE {x} {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in shape.SHOWN.items())} ELSE {x} END"


@query(f"SELECT row_id, {_shown_sql('family')} AS shown FROM (SELECT row_id, {GROUPS} AS family FROM corpus_raw)")
def j11_shown_names(spark, d):
    return table(spark, d, "corpus_raw", "row_id", shape.shown_name(corpus.model_group(F.col("model"))).alias("shown"))


@query(
    rf"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: left(w, 1)) AS t FROM {DOCS}),
    p AS (SELECT doc_id, t[i] || '->' || t[i + 1] AS pair FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t)), c AS (SELECT doc_id, pair, count(*) AS c FROM p GROUP BY ALL),
    e AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c GROUP BY 1) SELECT doc_id, round(coalesce(h, 0), 6)::DOUBLE AS entropy FROM t LEFT JOIN e USING (doc_id)"""
)
def w10_transition_entropy(spark, d):
    """Entropy of neighbouring pairs in each document's sequence of word initials, which stand for tags."""
    initials = F.transform(X.tokens("text"), lambda w: F.substring(w, 1, 1))
    return documents(spark, d).select("doc_id", shape.bigram_entropy(initials).alias("entropy"))


@query(f"WITH s AS (SELECT doc_id, {sentences_sql('text')} AS s FROM {DOCS}) SELECT doc_id, unnest(range(len(s)))::BIGINT AS idx, unnest(s) AS sentence FROM s")
def udf_sentences(spark, d):
    """The table function from SQL."""
    names.register(spark)
    documents(spark, d).createOrReplaceTempView("lectern_docs")
    return spark.sql("SELECT doc_id, s.idx, s.sentence FROM lectern_docs, LATERAL sentences(text) s")


@query("SELECT doc_id, nfc_normalize(text) AS nfc FROM documents WHERE text IS NOT NULL")
def udf_nfc(spark, d):
    names.register(spark)
    documents(spark, d).createOrReplaceTempView("lectern_docs")
    return spark.sql("SELECT doc_id, nfc(text) AS nfc FROM lectern_docs")


@query()
def udf_features(spark, d):
    """All scalar names from SQL."""
    names.register(spark)
    documents(spark, d).createOrReplaceTempView("lectern_docs")
    return spark.sql("SELECT doc_id, stylo_features(text) AS f, mtld(text) AS mtld, nfkc(text) AS nfkc, erfc(length(text) / 1000.0D) AS tail FROM lectern_docs").selectExpr(
        "doc_id", "f.char_entropy", "f.n_words", "mtld", "sha2(nfkc, 256) AS nfkc_sha", "tail"
    )


@query()
def w3_analysed_sentences(spark, d):
    """Sentence scores by windows, with single sentences and 0.5 to fall back on."""
    return detect.analysed_sentences(documents(spark, d), "doc_id")


@query(f"WITH {SCORES} SELECT row_id, CASE WHEN stylometric_score >= 0.5 THEN 'AI' ELSE 'human' END AS label, round(greatest(stylometric_score, 1 - stylometric_score), 6)::DOUBLE AS confidence FROM s WHERE stylometric_score IS NOT NULL")
def m13_label_and_confidence(spark, d):
    named = scoring.label_and_confidence(F.col("stylometric_score"))
    return scores(spark, d).filter("stylometric_score is not null").select("row_id", named.alias("x")).select("row_id", "x.*")


@query(
    f"""WITH {SCORES}, a AS (SELECT row_id, stylometric_score AS p, binoculars_score AS r FROM s WHERE stylometric_score IS NOT NULL),
    b AS (SELECT *, CASE WHEN p < 0.25 THEN 'human' WHEN r > 0.6 THEN 'reasoning' WHEN 1 - p >= 0.6 * p AND p <= 0.6 THEN 'human' ELSE 'openai' END AS source FROM a)
    SELECT row_id, {_shown_sql('source')} AS source, round(CASE WHEN p < 0.25 THEN 1 - p WHEN source = 'reasoning' THEN r WHEN source = 'human' THEN 1 - p ELSE 0.6 * p END, 6)::DOUBLE AS confidence FROM b"""
)
def m11_records(spark, d):
    """Sources with confidences and shown names: the score parted among a human and two machine classes, the second
    score standing for that of reasoning models."""
    p = F.col("stylometric_score")
    classes = {"human": 1 - p, "openai": 0.6 * p, "llama": 0.4 * p}
    record = scoring.attribution_record(p, classes, F.col("binoculars_score")).alias("x")
    rows = scores(spark, d).filter("stylometric_score is not null").select("row_id", record)
    return rows.select("row_id", shape.shown_name(F.col("x.source")).alias("source"), "x.confidence")


@query()
def r11_synthetic(spark, d):
    """Means and deviations of the synthetic profiles, and of the synthetic calibration set."""
    p = sampling.synthetic_profiles(spark).unpivot(["profile"], list(sampling.PROFILE_FEATURES), "feature", "value")
    c = sampling.synthetic_calibration(spark).unpivot([F.lit("calibration").alias("profile")], ["p"], "feature", "value")
    both = p.unionByName(c).groupBy("profile", "feature")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 1).alias("mean"))


# ---- models --------------------------------------------------------------------------------------------------------
def styled(spark, d, columns: list[str] = STYLE):
    """Labelled documents with features, written once."""
    docs = documents(spark, d, "label", "register").filter("label in (0, 1)")
    docs = docs.withColumn("register", F.nullif(F.lower(F.trim("register")), F.lit("")))
    return written(kernel.with_features(docs, columns=columns).drop("text", "n_words", "n_sents"))


def signals(spark, d):
    """Complete scores of corpus rows."""
    return written(scores(spark, d).dropna())


@query()
def m1_scored_by_register(spark, d):
    """Held-out probabilities of labelled documents by the forest of their register, saved and loaded before use."""
    from lectern.plans.stage import shared_folder

    rows = written(sampling.split(styled(spark, d), ["label"], "doc_id", 0.3))
    models = modeling.fitted_by_register(rows.filter("not is_test"), STYLE)
    path = f"{shared_folder(spark)}/models-by-register"
    modeling.save_models(models, path, spark)
    scored = modeling.scored_by_register(rows.filter("is_test"), modeling.load_models(path, spark))
    return scored.select("doc_id", "register", "scored_as", "label", "p")


@query()
def m1_detected_by_models(spark, d):
    """The batch detection of requests with the models of their registers in place of the fixed score."""
    models = modeling.fitted_by_register(styled(spark, d), STYLE)
    requests = table(spark, d, "detect_request", "request_id", "text", "register", "sensitivity")
    return detect.detected(spread(requests), "request_id", sensitivity_col="sensitivity", scorer=detect.model_scorer(models))


@query()
def m2_registers(spark, d):
    """The register found for each held-out document, with its confidence."""
    rows = written(sampling.split(styled(spark, d), ["label"], "doc_id", 0.3))
    model = modeling.register_classifier(rows.filter("not is_test"), STYLE)
    test = rows.filter("is_test").dropna(subset=STYLE)
    return modeling.with_register(test, model).select("doc_id", "register", "register_found", "register_confidence")


@query()
def m4_hybrid(spark, d):
    """Hybrid probabilities of held-out corpus rows: eleven features and the scores there are, missing ones at their
    fixed values."""
    texts = table(spark, d, "corpus_raw", "row_id", "text")
    rows = scores(spark, d).join(texts, "row_id")
    f = kernel.with_features(rows, columns=kernel.ORIGINAL).drop("text", "n_words", "n_sents")
    f = written(sampling.split(f, ["label"], "row_id", 0.3))
    neural = {"binoculars": "binoculars_score", "semantic": "stylometric_score"}
    wide, columns = modeling.hybrid_columns(f.filter("not is_test"), neural)
    models = modeling.fitted_by_register(wide, columns, kind="lr")
    return modeling.hybrid_scored(f.filter("is_test"), models, neural).select("row_id", "register", "label", "second")


@query()
def m20_random_search(spark, d):
    return modeling.random_search(signals(spark, d), SIGNALS, "row_id")


@query()
def m21_selected_models(spark, d):
    return modeling.selected_models(signals(spark, d), SIGNALS, "row_id")


@query()
def m22_ensemblers(spark, d):
    rows = written(sampling.split(signals(spark, d), ["label"], "row_id", 0.3))
    neural = ["binoculars_score", "binoculars_score_neg"]
    return modeling.ensembler_strategies(rows.filter("not is_test"), rows.filter("is_test"), ["stylometric_score"], neural)


@query()
def m23_regularisation(spark, d):
    rows = written(sampling.split(signals(spark, d), ["label"], "row_id", 0.3))
    return modeling.regularisation(rows.filter("not is_test"), rows.filter("is_test"), SIGNALS)


@query()
def m24_ablation(spark, d):
    """Cross-validated AUC with the 1, 2, 4, 6 and 11 features of the largest effects."""
    rows = styled(spark, d, kernel.ORIGINAL).withColumn("all", F.lit("all"))
    effects = stats.effect_sizes_wide(rows, "all", kernel.ORIGINAL).select("feature", F.abs("cohens_d").alias("size")).distinct()
    order = [r[0] for r in effects.orderBy(F.col("size").desc_nulls_last(), "feature").collect()]
    return training.ablation(rows, order, (1, 2, 4, 6, 11), "doc_id")


@query()
def m28_forest_against_logistic(spark, d):
    return modeling.forest_against_logistic(signals(spark, d), SIGNALS, "row_id", "register")


@query()
def m28_coefficients(spark, d):
    return modeling.coefficients(styled(spark, d, kernel.ORIGINAL), kernel.ORIGINAL)


@query()
def z7_introspection(spark, d):
    """What the library offers: features, profiles, detectors, rewrites and SQL names."""
    rows = [("feature", f) for f in kernel.ALL] + [("rewrite", s) for s in perturb.STRATEGIES] + [("sql", n) for n in names.NAMES]
    rows += [("profile", p) for p in ("serve", "v0", "train", "adversarial")] + [("detector", x) for x in shape.DETECTORS]
    return spark.createDataFrame(rows, "kind string, name string")
