"""The feature kernel against counts by hand."""

import math

import numpy as np
import pytest

from lectern.functions import features as FX
from lectern.functions import kernel


def one(text: str, **settings) -> dict:
    return {k: v[0] for k, v in kernel.measure([text], **settings).items()}


def test_content_word_features_by_hand():
    # Content words: house, red, house, garden, red, bird; so 4 types of 6, two of them once.
    f = one("The house is red. A house in the garden and a red bird.")
    assert f["type_token_ratio"] == pytest.approx(4 / 6) and f["hapax_legomena_ratio"] == pytest.approx(2 / 6)
    assert f["yules_k"] == pytest.approx(1e4 * (10 - 6) / 36) and f["simpsons_d"] == pytest.approx(1 - 10 / 36)
    assert f["rep_rate"] == pytest.approx(4 / 6)
    # Sentences of 4 and 9 words.
    assert f["mean_sent_len"] == 6.5 and f["sent_length_std"] == pytest.approx(math.sqrt(12.5))
    assert f["n_words"] == 13 and f["n_sents"] == 2


def test_record_has_39_features(spark):
    df = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog."), (2, "hi"), (3, None), (4, "")], "i int, text string")
    got = {r.i: r for r in FX.record(df.selectExpr("*", "1 as mtld", "2 as n_words")).collect()}
    assert len(FX.ALL) == 39 and set(FX.ALL) <= set(got[1].asDict()) and all(got[1][f] is not None for f in FX.ALL)
    assert (got[1].noun_verb_ratio, got[1].adj_adv_ratio, got[1].pos_transition_entropy) == (1.5, 1.0, 0.0)
    assert all(got[i][f] is None for i in (2, 3, 4) for f in FX.ALL)
    assert got[4].n_words == 0 and got[3].n_words is None
    v = {r.i: r.vector for r in kernel.vector(df, ["mean_sent_len", "nothing"]).collect()}
    assert v[1] == [9.0, 0.0] and v[2] is None
    assert FX.record(df.limit(0)).count() == 0


def test_capitalised_entities_and_styled_letters():
    assert one("The weather is nice today. It is sunny.")["capitalized_entity_density"] == 0
    assert one("The United States is a country. It is large.")["capitalized_entity_density"] == pytest.approx(1000 / 9)
    assert one("ＴＨＥ ｒｅｄ house is over there", compose=True)["preposition_density"] == one("THE red house is over there")["preposition_density"]


def test_lists_follow_the_language():
    text = "La casa es de la gente que vive en el norte y puede claramente ver el mar"
    assert kernel.language(text) == "es" and kernel.language("xyz") == ""
    assert one(text, lang=None)["boost_density"] == pytest.approx(1000 / one(text)["n_words"])
    assert one(text)["boost_density"] == 0


def test_profiles_differ_as_defined():
    text = "However, we can't go. Then it ended\nhowever they may stay here, truly. Next one! " * 4
    serve, loud = one(text), one(text, name="adversarial")
    assert loud["n_sents"] == 16 and loud["opener_ratio"] == 1.0 and serve["opener_ratio"] < 1
    assert one("short text of five words", name="v0")["enough"] == np.False_
    assert one("word " * 49, name="train")["enough"] == np.False_ and one("word " * 50, name="train")["enough"] == np.True_
    with pytest.raises(ValueError):
        kernel.profile("none")


def test_characters_of_a_cjk_text_are_words():
    f = one("我们可能去北京。他们也许不来了吗。")
    assert f["n_words"] == 15 and f["mean_sent_len"] == 15


def test_many_texts_equal_one_by_one():
    texts = ["The house is red. We saw it.", None, "", "x" * 300_000, "Perhaps 3 of 4 (NATO) staff were told, e.g. a@b.org or http://x.y \"now\"."] * 3
    both = [kernel.measure([t]) for t in texts]
    joined = kernel.measure(texts)
    for k in joined:
        assert np.array_equal(joined[k].astype(float), np.concatenate([b[k] for b in both]).astype(float), equal_nan=True), k
