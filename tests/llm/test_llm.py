"""Small cases of each operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns; brute force where SQL can't say it."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lectern.functions import codepoints as cp
from lectern.llm import abuse, collapse, cube, cutoff, leak, level, lookalike, mixing, neardup

VOCAB = [a + b for a in "ba ke lo mi nu pra ste vor zan dul".split() for b in "ron tel mas vik dor lan pey gus".split()]


def text(seed: int, n: int = 40) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


# ---- 3 near duplicates
def runs3(t: str) -> set:
    w = re.findall(r"[^\W_]+", t.lower())
    return set(zip(w, w[1:], w[2:]))


def test_near_duplicates_match_brute_force(spark):
    rows = []
    for i in range(60):
        words = text(i).split()
        rows.append((3 * i, " ".join(words)))
        words[5] = "changed"
        rows.append((3 * i + 1, " ".join(words)))
        rows.append((3 * i + 2, " ".join(words[20:] + words[:20]).upper()))
    rows += [(900, None), (901, ""), (902, "too short"), (903, rows[0][1]), (904, text(500, 20_000))]
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "1 as id", "2 as blocks")
    members, links = neardup.near_duplicates(df, k=3, threshold=0.6, least_words=20)
    got = {tuple(r) for r in neardup.expanded(members, links).collect()}
    sets = {i: runs3(t) for i, t in rows if t and len(t.split()) >= 20}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got == want and (0, 903) in got
    models = df.selectExpr("row_id as id", "'m' || (row_id % 2) as model")
    groups = {r.row_id: (r.group_id, r.rows) for r in neardup.groups(members, links, models).collect()}
    assert groups[0] == (0, 4) and groups[903][0] == 0 and 902 not in groups


def test_near_duplicates_of_nothing(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], "row_id long, text string"))
    assert neardup.expanded(members, links).count() == 0


def test_connected_parts(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    got = {r.id: r.root for r in neardup.connected(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


# ---- 4 formatting copies
def test_copies_with_a_hot_key_over_partitions(spark):
    base = text(1)
    rows = [(i, base.upper() if i % 2 else base.replace(" ", ",  ")) for i in range(300)]
    rows += [(1000, '{"a": "one two", "b": "three"}'), (1001, "b: three!\nA: One Two"), (1002, "a=one  two; b=three"), (1003, "c three a one two")]
    rows += [(2000, None), (2001, ""), (2002, ""), (2003, text(7)), (2004, "Straße"), (2005, "STRASSE")]
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "'x' as k", "1 as head")
    kept = {r.row_id: r.keep_id for r in collapse.collapse_copies(df, "row_id", "text").collect()}
    assert {kept[i] for i in range(300)} == {0}
    assert kept[1001] == kept[1002] == 1000 and kept[1003] == 1003
    assert kept[2002] == 2001 and kept[2003] == 2003 and 2000 not in kept and kept[2005] == 2004
    counts = {r.keep_id: r.copies for r in collapse.copy_counts(df).collect()}
    assert counts[0] == 300 and counts[1000] == 3 and sum(counts.values()) == len(rows) - 1
    assert collapse.copies_found(spark.createDataFrame([], "row_id long, text string")).count() == 0


# ---- 6 look-alikes
def test_alike_and_visible_differences(spark):
    base = "Café naïve " + text(3)
    same = [base.replace("é", "é"), base.replace("o", "о"), base.replace(" ", " "), base.replace("a", "a​"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in base)]
    other = [base, base.replace("é", "e"), base.upper(), base + ".", base.replace(" ", "\n", 1), None, ""]
    left = spark.createDataFrame([(1, base), (2, "Café short"), (3, None)], "row_id long, text string").selectExpr("*", "1 as id", "'m' as m")
    right = spark.createDataFrame(list(enumerate(same + other)), "request_id long, text string")
    got = {r.request_id for r in lookalike.alike(left, right, "row_id", "request_id").collect()}
    assert got == set(range(len(same)))
    forms = {r.id: r.form for r in lookalike.one_form(right, "request_id", "text").collect()}
    assert len({forms[i] for i in range(len(same) + 1)}) == 1 and forms[len(same) + 5] is None and forms[len(same) + 6] == ""


# ---- 7 leaks
def test_suffix_automaton_matches_brute_force():
    r = random.Random(5)
    sequences = [[r.randrange(4) for _ in range(30)] for _ in range(5)]
    a = leak.SuffixAutomaton(sequences)
    words = [r.randrange(5) for _ in range(200)]
    got = {(i, s, at) for i, state in a.matches([w if w < 4 else -1 for w in words], 3) for s, at in a.ends(state)}
    for i, s, at in got:
        assert words[i - 2 : i + 1] == sequences[s][at - 2 : at + 1]
    whole = {(s, i - at) for i in range(2, 200) for s, q in enumerate(sequences) for at in range(2, 30) if words[i - 2 : i + 1] == q[at - 2 : at + 1]}
    assert {(s, i - at) for i, s, at in got} == whole


def test_leaks(spark):
    passage = text(11, 50)
    words = passage.split()
    replaced = [w if i % 10 else "other" for i, w in enumerate(words)]
    docs = [(1, text(12) + " " + passage + " " + text(13)), (2, "**" + "** ".join(replaced[5:35])), (3, " ".join(words[:15])), (4, " ".join(w if i % 4 else "x" for i, w in enumerate(words))), (5, None), (6, ""), (7, passage.upper().replace(" ", ", "))]
    items = spark.createDataFrame([(10, passage), (11, passage), (12, None), (13, "")], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(d, i) for d in (1, 2, 7) for i in (10, 11)}
    assert leak.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0


# ---- 5 sample
def test_cube_keeps_sums_and_targets(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(60), rng.integers(0, 2, 60), rng.integers(0, 2, 60)]).astype(float)
    pi = np.full(60, 0.3)
    out = cube.flight(pi, x, rng)
    assert np.allclose(x.T @ out, x.T @ pi) and ((out > 1e-6) & (out < 1 - 1e-6)).sum() <= 3
    rows = [(i, "t", " News " if i % 2 else "social", i % 2, "A") for i in range(4000)] + [(5000, None, "news", 1, "a"), (5001, "t", None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, text string, register string, label int, model string").repartition(40)
    targets = spark.createDataFrame([(1, "news", 1, "a", 0.5, 5), (2, "social", 0, "a", 0.3, 5), (3, "poetry", 0, "a", 0.2, 3)], "cell_id long, register string, label int, model string, target_share double, min_rows long")
    s = cube.CubeSample(df, targets)
    assert s.size == 800
    report = {r.cell_id: r for r in s.report().collect()}
    assert report[3].short and not report[1].short and report[1].sampled == 500 and report[2].sampled == 300
    drawn = s.rows.collect()
    assert len({r.id for r in drawn}) == len(drawn) == 800
    empty = cube.CubeSample(df.limit(0), targets)
    assert empty.rows.count() == 0 and all(r.short for r in empty.report().collect())


# ---- 8 mix
def test_rake_meets_targets_and_caps():
    tokens = np.array([100.0, 300, 50, 50, 20])
    source, lang = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 0, 1, 0])
    target = np.array([200.0, 150, 90])
    often = mixing.rake(tokens, source, [lang], target, np.array([2.0, 2, 2, 2, 3]))
    used = np.bincount(source, tokens * often)
    assert np.allclose(used, [200, 150, 60]) and (often <= [2, 2, 2, 2, 3]).all()


def test_mix(spark):
    rows = [(i, "a word here " * 5, "EN" if i % 2 else None, "big", None) for i in range(400)] + [(1000 + i, "a word here " * 5, "en", "small", "news") for i in range(10)] + [(2000, None, None, "big", None), (2001, "", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, register string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, weight double, max_repeats int")
    m = mixing.Mix(docs, targets)
    r = {x.source: x for x in m.report().collect()}
    assert r["small"].short and r["none"].short and not r["big"].short
    assert r["small"].used_tokens == 3 * r["small"].tokens and abs(r["big"].used_tokens / r["big"].target_tokens - 1) < 0.25
    assert mixing.Mix(docs.limit(0), targets).docs.count() == 0


# ---- 1 cuts
def test_censored_fit_recovers_parameters():
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(6, 0.5, 20000))
    v, n = np.unique(np.where(x > 600, 600, x.round()), return_counts=True)
    mu, sd = cutoff.censored_fit(v, n.astype(float), np.where(v == 600, n, 0).astype(float))
    assert abs(mu - 6) < 0.03 and abs(sd - 0.5) < 0.03


def test_cuts(spark):
    r = random.Random(2)
    rows = []
    for i in range(1500):
        t = " ".join(text(10 * i + k, r.randrange(6, 14)).capitalize() + "." for k in range(r.randrange(4, 14)))
        if i % 3 == 0:
            t = t[:300]
        elif i % 7 == 0:
            t += " thanks in advance"
        rows.append((i, "s", t))
    rows += [(9000, None, None), (9001, "s", ""), (9002, "s", "  "), (9003, None, "It goes on and [truncated]"), (9004, "s", "One. Two and �")]
    df = spark.createDataFrame(rows, "row_id long, source string, text string").selectExpr("*", "1 as tab", "2 as word")
    got = {x.id for x in cutoff.cut_records([(0, df, "row_id")]).collect()}
    cut = {i for i, _, t in rows[:1500] if i % 3 == 0 and len(t) == 300 and not t.rstrip().endswith(".")}
    assert len(cut & got) > 0.97 * len(cut) and len({i for i in got if i < 1500} - {i for i in range(0, 1500, 3)}) < 15
    assert {9003, 9004} <= got and not {9000, 9001, 9002} & got
    assert cutoff.cut_records([(0, df.limit(0), "row_id")]).count() == 0


# ---- 2 levels
def test_levels(spark):
    easy = "The cat sat on the mat. I like the red ball. We ran to the big tree. He has a dog and a pig. "
    hard = "Notwithstanding the epistemological indeterminacy that characterises institutional reconceptualisation, intergenerational stratification systematically problematises the phenomenological generalisability of longitudinal approximations, insofar as multivariate operationalisation presupposes heterogeneous methodologies. "
    mid = "The council decided on Thursday that the new station will open before the holidays because the workers finished the main hall. "
    rows = []
    for i in range(300):
        r = random.Random(i)
        t = " ".join(r.choices([easy, mid, hard], [(i % 3 == 0) + 0.01, (i % 3 == 1) + 0.01, (i % 3 == 2) + 0.01])[0] for _ in range(3))
        rows.append((i, " ".join(f"{t}{w}" for w in [text(i, 3)]), "news", f"s{i % 6}"))
    rows += [(1000, easy * 3, "News", "s1"), (1001, hard * 3, None, None), (1002, None, None, None), (1003, "", "x", "y"), (1004, (easy * 3).replace(".", "").upper(), "a", "b"), (1005, "...", "a", "b"), (1006, hard * 400, "a", "b")]
    df = spark.createDataFrame(rows, "row_id long, text string, register string, source string").selectExpr("*", "1 as grade")
    got = {r.id: r.band for r in level.graded(df).collect()}
    assert got[1000] == "easy" and got[1001] == "hard" and got[1004] == "easy" and got[1006] == "hard"
    assert 1002 not in got and 1003 not in got and 1005 not in got
    assert level.graded(df.limit(0)).count() == 0
    model = level.fitted(df, "row_id", "text", "source")
    assert model.cv["mae"].mean() < 1.5


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = np.where(x[:, 0] > 0.5, 3, 0) + x[:, 1] ** 2
    m = level.Boosted(rounds=60).fit(x[:1500], y[:1500])
    assert np.abs(m.predict(x[1500:]) - y[1500:]).mean() < 0.15


# ---- 9 abuse
def test_network_gradients():
    net = abuse.Network(["aa", "bb", "cc"], 3)
    grams = [abuse.trigrams(w) for w in ("aa", "bb", "cc")]
    at, mask, y = np.array([[0, 1], [2, 2], [1, 0]]), np.array([[1, 1], [1, 1], [1, 0]], np.float32), np.array([1, 0], np.float32)

    def loss(n):
        x = (n.p["word"][[1, 2, 3]] + np.stack([n.p["chars"][g].mean(axis=0) for g in grams]))[at] * mask[:, :, None]
        p = n.forward(x, mask)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    kept = {}
    net._adam = lambda k, rows, g, rate: kept.__setitem__(k, g)
    net.step(np.array([1, 2, 3]), grams, at, mask, y, np.ones(2, np.float32), 0.0)
    for k in ("Uf", "Ub", "Wf", "Wb", "cf", "A", "v", "o"):
        index = np.unravel_index(np.abs(kept[k]).argmax(), kept[k].shape)
        eps, old = 1e-2, net.p[k][index]
        net.p[k][index] = old + eps
        up = loss(net)
        net.p[k][index] = old - eps
        down = loss(net)
        net.p[k][index] = old
        assert abs((up - down) / (2 * eps) - kept[k][index]) < 0.02 * max(1e-2, abs(kept[k][index])) + 2e-3


def test_abuse_held_out(spark):
    bad = ["you are a filthy zorgwit and everyone knows", "go home you stupid grabbler nobody wants you", "all of these blimfolk should be thrown out now"]
    docs, labels = [], []
    for i in range(400):
        s = [text(100 * i + k, 9) + "." for k in range(8)]
        toxic = i % 4 == 0
        if toxic:
            s[i % 8] = bad[i % 3] + "."
        docs.append((i, "s", " ".join(s)))
        if i < 260:
            labels.append((i, None if i % 50 == 7 else int(toxic) if i % 29 else 1 - int(toxic)))
    docs += [(1000, None, None), (1001, "s", ""), (1002, "s", "go home you s t u p i d gr4bbler nobody wants you " + text(9, 10))]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as score")
    got = {r.doc_id: r.score for r in abuse.scored(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = range(260, 400)
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held) and got[1000] == got[1001] == 0 and got[1002] >= 0.5
    none = abuse.scored(d.limit(3), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in none.collect()} == {0.0}


@pytest.mark.parametrize("raw,plain", [("5tup1d", "stupid"), ("p.a.t.h.e.t.i.c", "pathetic"), ("Horrrrrny!", "horny"), ("42", "<num>"), ("саt", "cat"), ("...", "")])
def test_normal_words(raw, plain):
    assert abuse.normal_word(raw) == plain


# ---- kernels
def test_code_point_kernel():
    texts = ["Héllo, wörld 1_2", None, "", "東京 x² ½", "a" * 600_000 + " b", "İstanbul ß"]
    want = [re.findall(r"[^\W_]+", t or "") for t in texts]
    got = []
    for p in cp.passes(pa.array(texts)):
        start, end, first = cp.words(p)
        s = np.ascontiguousarray(p.code).tobytes().decode("utf-32-le")
        got += [[s[a:b] for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])] for i in range(len(first) - 1)]
    assert got == want
    assert cp.hash_word("HÉLLO") == cp.hash_word("héllo") != cp.hash_word("hello")
    assert pd.Series([1]).sum() == 1
