"""Details of the training-data operators: spans, exchanges, filters, forms, limits by words."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lectern.llm import abuse, bloom, collapse, cube, cutoff, leak, lookalike, mixing, neardup

VOCAB = [a + b for a in "ba ke lo mi nu pra ste vor zan dul".split() for b in "ron tel mas vik dor lan pey gus".split()]


def text(seed: int, n: int = 40) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def other(seed: int, n: int) -> str:
    """Words that no passage has."""
    return " ".join(w + "q" for w in text(seed, n).split())


def test_leaked_spans_and_cleaned_texts(spark):
    passage = text(1, 60)
    words = passage.split()
    hidden = " ".join(words[10:40]).replace("a", "a​", 3)
    accented = passage.replace("e", "é", 4)
    items = spark.createDataFrame([(7, passage), (8, passage), (9, None), (10, "")], "item_id long, passage string")
    docs = [
        (1, other(100, 50) + " " + hidden.upper() + ", " + other(101, 50)),
        (2, accented),
        (3, other(102, 80)),
        (4, None),
        (5, ""),
        (6, other(103, 5) + " " + " ".join(words[:12])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as words", "2 as spans")
    spans = {(r.doc_id, r.item_id): r for r in leak.leaked_spans(df, items).collect()}
    assert set(spans) == {(1, 7), (1, 8), (2, 7), (2, 8)}
    one = spans[1, 7]
    assert (one.first_word, one.last_word, one.leaked, one.coverage) == (50, 80, 30, 0.5)
    assert docs[0][1][one.first_char : one.last_char] == hidden.upper()
    clean = {r.doc_id: r for r in leak.cleaned(df, items).collect()}
    assert clean[1].text == other(100, 50) + " , " + other(101, 50) and clean[1].removed_words == 30 and not clean[1].whole
    assert clean[2].whole and clean[2].text is None
    assert clean[3].text == docs[2][1] and clean[4].text is None and clean[5].text == "" and clean[6].removed_words == 0
    assert leak.leaked_spans(df.limit(0), items).count() == 0 and leak.cleaned(df, items.limit(0)).count() == 6


def test_longest_stretch_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(20, 60))
        passage = rng.integers(0, 10**9, n).astype(np.uint64)
        doc = np.where(rng.random(n) < 0.15, np.uint64(1), passage)
        start, end = leak.longest(passage, doc, 0, 20, 0.1)
        same = passage == doc
        fits = [(j - i, i, j) for i in range(n) for j in range(i + 20, n + 1) if (~same[i:j]).sum() <= 0.1 * (j - i) + 1e-9]
        best = max((f[0] for f in fits), default=0)
        trimmed = {(i + np.flatnonzero(same[i:j])[0], i + np.flatnonzero(same[i:j])[-1] + 1) for n_, i, j in fits if n_ == best}
        assert (start, end) in (trimmed or {(0, 0)})


def test_exchange_keeps_the_sum_and_decides_one():
    rng = np.random.default_rng(1)
    drawn = []
    for _ in range(4000):
        p, q = cube._exchange(0.3, 0.9, rng.random())
        assert p + q == pytest.approx(1.2) and (p in (0.0, 1.0) or q in (0.0, 1.0))
        drawn.append(p)
    assert np.mean(drawn) == pytest.approx(0.3, abs=0.03)


def test_cells_at_their_target_give_all_rows():
    cells = pd.DataFrame({"available": [5, 100, 1000], "target_share": [0.1, 0.4, 0.5], "min_rows": [1, 1, 1]})
    want = cube.wanted(cells, 200)
    assert want[0] == 5 and want.sum() == pytest.approx(200)


def test_bloom_filter_loses_no_id(spark):
    ids = spark.range(0, 30000, 3)
    words = bloom.bloom(ids)
    held = bloom.may_hold(words, np.arange(30000))
    assert held[::3].all() and held.mean() < 0.37
    assert bloom.may_hold(bloom.bloom(ids.limit(0)), np.arange(100)).sum() == 0


def test_form_hashes_equal_the_hashes_of_forms(spark):
    rows = [(1, "café one"), (2, "café one"), (3, "cafe one"), (4, "ｃａfe one"), (5, None), (6, ""), (7, "саfé one")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as m", "2 as s")
    full = {r.id: r.form for r in lookalike.one_form(df, "id", "text").selectExpr("id", "sha2(form, 256) as form").collect()}
    assert {r.id: r.form for r in lookalike.form_hashes(df, "id", "text").collect()} == full
    assert full[1] == full[2] == full[7] and full[3] == full[4] != full[1]


def test_copies_with_several_readings_of_their_fields(spark):
    rows = [(1, "a: one\nb: two"), (2, "b: two\na: one"), (3, "a: one; b: two"), (4, "A one. B two"), (5, "zz")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    got = {r.row_id: r.keep_id for r in collapse.collapse_copies(df, "row_id", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_systematic_draws_meet_a_small_share(spark):
    rows = [(i, text(i, 20), "en", "s" if i < 400 else "big", "news") for i in range(4400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, register string")
    targets = spark.createDataFrame([("s", 0.03, 1), ("big", 0.97, 4)], "source string, weight double, max_repeats int")
    mix = mixing.Mix(df.repartition(3), targets)
    shares = {r.source: r.actual_share for r in mix.report().collect()}
    assert shares["s"] == pytest.approx(0.03, abs=0.001) and not any(r.short for r in mix.report().collect())


def test_threshold_from_held_out_scores_and_saved_network(tmp_path):
    y = np.array([True] * 50 + [False] * 50)
    score = np.where(y, 0.99, 0.1)
    score[50:60] = 0.86
    assert abuse.held_out_threshold(score, y) == 0.98
    net = abuse.Network(["some", "words"], 3)
    abuse.saved(net, str(tmp_path / "net.npz"))
    back = abuse.loaded(str(tmp_path / "net.npz"))
    assert back.vocabulary == net.vocabulary and all((back.p[k] == v).all() for k, v in net.p.items())


def test_endings():
    kinds = {
        "It ends.": cutoff.CLOSED,
        "It stops. And then the": cutoff.OPEN,
        "It stops. We saw it (see": cutoff.UNCLOSED,
        "It stops. We <a hre": cutoff.BROKEN_END,
        "It stops. More (see ht": cutoff.BROKEN_END,
        "It stops [+12 chars]": cutoff.MARKED,
        "So it goes...": cutoff.DOTTED,
        "It is nice :(": cutoff.PAUSE,
    }
    assert {t: cutoff.ending(t)[0] for t in kinds} == kinds


def test_limit_by_words_in_a_mixture_of_lengths():
    rng = np.random.default_rng(5)
    long, short = np.exp(rng.normal(5, 0.3, 4000)), np.exp(rng.normal(3.5, 0.3, 2000))
    v = np.minimum(np.concatenate([long, short]).astype(int), 160)
    length, n = np.unique(v[v > 0], return_counts=True)
    found = cutoff.find_limits(pd.DataFrame({"length": length, "n": n, "different": n}))
    assert found["length"].tolist() == [160] and found["posterior"].iloc[0] > 0.9


def test_few_texts_and_no_words(spark):
    rows = [(1, "s", "-"), (2, "s", "..."), (3, None, "n/a"), (4, "s", "One. Two [...]"), (4, "s", "One. Two [...]")]
    df = spark.createDataFrame(rows, "row_id long, source string, text string")
    assert [r.id for r in cutoff.cut_records([(0, df, "row_id")]).collect()] == [4]


def test_large_blocks_give_the_same_links(spark, monkeypatch):
    rows = []
    for i in range(40):
        words = text(7, 60).split()
        words[i] = f"new{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "row_id long, text string")
    run = lambda: {tuple(r) for r in neardup.near_duplicates(df, k=3, threshold=0.6)[1].select("a", "b").collect()}
    whole = run()
    monkeypatch.setattr(neardup, "LARGE", 1)
    assert run() == whole and len(whole) == 40 * 39 // 2
    monkeypatch.setattr(neardup, "HOT", 2)
    assert run() == whole


def test_parted_blocks_keep_near_pairs_apart_from_boilerplate():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, neardup.SIZE).astype(np.uint8)
    near = np.where(rng.random((300, neardup.SIZE)) < 0.65, base, rng.integers(0, 256, (300, neardup.SIZE)).astype(np.uint8))
    far = np.where(rng.random((300, neardup.SIZE)) < 0.2, base, rng.integers(0, 256, (300, neardup.SIZE)).astype(np.uint8))

    def met(prints: np.ndarray) -> float:
        prints = np.vstack([base, prints])
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(301, 5, np.int64)), pa.array(np.arange(301)), pa.array([x.tobytes() for x in prints], pa.binary())],
            names=["block", "id", "print"],
        )
        out = pd.concat([b.to_pandas() for b in neardup._refined([batch])])
        mine = set(out["block"][out["id"] == 0])
        return out[out["id"] > 0].groupby("id")["block"].agg(lambda x: bool(mine & set(x))).mean()

    assert met(near) > 0.98 and met(far) < 0.1
