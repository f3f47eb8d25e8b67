"""Literal cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import features as FX
from lectern.functions import text as X
from lectern.functions.unicode import nfc, nfkc
from lectern.operators import perturb


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(column.alias("x")).collect()
    return [r.x for r in rows]


def test_sentences(spark):
    got = one(spark, X.sentences("t"), 'Hello there. World is ok! (yes) no? ok. "Q"', "", None, "One. É two.")
    assert got[0] == ["Hello there.", "World is ok!", "(yes) no? ok.", '"Q"']
    assert got[1] == [""] and got[3] == ["One. É two."]


def test_offsets_tile_the_text(spark):
    t = "This is a sentence. And here is another! Is this a third sentence? Yes. ..."
    got = one(spark, X.sentence_offsets("t"), t)[0]
    assert [t[s.start : s.end].strip() for s in got] == [s.text for s in got] and len(got) == 4


def test_words(spark):
    got = one(spark, X.words("t"), "éa x² ½ a‿b हिन्दी 12", "東京の港です", None, "")
    assert got[0][:4] == ["éa", "x²", "a", "b"] and "12" not in got[0]
    assert got[1] == list("東京の港です") and got[3] == []


def test_syllables_in_one_pass_as_word_by_word(spark):
    words = "a the table houses wanted yes yellow rhythm beautiful institutionalisation created e ye syl hmmm y".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    alone = df.select(F.sum(X.syllables(F.col("w"))), F.sum((X.syllables(F.col("w")) >= 3).cast("int"))).first()
    whole = spark.createDataFrame([(" " + " ".join(words) + " ",)], "s string").select(*X.syllable_counts(F.col("s"))).first()
    assert tuple(alone) == tuple(whole)


@pytest.mark.parametrize(
    "raw,clean",
    [("Thіs іs а tеst", "This is a test"), ("test ​‌ text ﻿", "test text"), ("word1   \t\n\n   word2", "word1 word2"), ("Hello!!!???...", "Hello!?."), (None, ""), ("Thіs іs а tеst​!", "This is a test!")],
)
def test_defensive(spark, raw, clean):
    assert one(spark, X.defensive("t", nfc("t")), raw) == [clean]


def test_normal_forms(spark):
    assert one(spark, nfkc("t"), "ﬁ Ａ", None, "plain") == ["fi A", None, "plain"]
    assert one(spark, nfc("t"), "é") == ["é"]


def test_language(spark):
    assert one(spark, X.language("t"), "this is the end of the day", "der Hund und die Katze von das Haus", "今天天气很好", "xyz", None)[:4] == ["en", "de", "zh", "unknown"]


def test_rebuilt(spark):
    df = spark.createDataFrame([(1, '{"a":[0,2],"b":[1]}'), (2, '{"x":[1],"y":[4]}'), (3, None)], "i long, idx string")
    assert {r.i: r.rebuilt for r in X.rebuilt(df, "i", "idx").collect()} == {1: "a b a", 2: " x   y"}


def test_chunks(spark):
    t = " ".join(map(str, range(950)))
    got = one(spark, X.chunks("t"), t, " ".join(map(str, range(400))))
    assert [c.start for c in got[0]] == [0, 400] and got[0][1].chunk.split()[0] == "400" and got[0][1].chunk.split()[-1] == "899" and got[1] == []


def test_features(spark):
    df = spark.createDataFrame([(1, "The United States is a country. It was quickly shown."), (2, "The weather is nice today. It is sunny."), (3, "hi"), (4, ""), (5, None)], "i long, text string").selectExpr("*", "1 as n_sents_")
    got = {r.i: r for r in FX.native(df).collect()}
    assert got[1].capitalized_entity_density > got[2].capitalized_entity_density == 0
    assert got[1].passive_density == 0 and got[3].mean_sent_len is None and got[4].mean_sent_len is None and got[5].mean_sent_len is None
    counts = {r.i: r for r in FX.counted(df).collect()}
    assert counts[3].mtld is None and counts[1].simpsons_d == pytest.approx(0.8)  # five content words, each once


def test_lexical_diversity():
    assert FX.lexical_diversity(["a"] * 10) == pytest.approx(2.0)
    distinct = [str(i) for i in range(20)]
    assert FX.lexical_diversity(distinct) == 20


def test_perturbations(spark):
    t = "However, it is important. Therefore we utilize many things."
    assert one(spark, perturb.without_connectors("t"), t) == ["It is important. We utilize many things."]
    # By the definition: a capital stays one, short sentences stay as they are, halves and pairs are joined as named.
    assert one(spark, perturb.swapped("t", 1.0), "However, it is important here") == ["But it is key here"]
    assert one(spark, perturb.in_first_person("t", 1.0), "a b c d. e") == ["a b c I d. e"]
    assert one(spark, perturb.repunctuated("t", 1.0, 0.0, 0.0), "A, b. C, d. E") == ["A; b. C; d. E"]
    assert one(spark, perturb.repunctuated("t", 0.0, 1.0, 0.0), "A, b. C. D") == ["A, b! C! D"]
    assert one(spark, perturb.repunctuated("t", 0.0, 0.0, 1.0), "A, b. C. D") == ["A, b? C. D"]
    assert perturb.vary(None) is None
    long = " ".join(f"w{i}" for i in range(12)) + ", " + " ".join(f"v{i}" for i in range(14))
    assert perturb.vary(long, 1.0, 1.0) == " ".join(f"w{i}" for i in range(12)) + ", v0. V" + " ".join(f"v{i}" for i in range(2, 14))
    assert perturb.vary("One two. Three FOUR! Five six.", 1.0, 1.0) == "One two, and three four! Five six."
    assert perturb.vary("One two. Three four.", 0.0, 0.0) == "One two. Three four."
    with pytest.raises(ValueError):
        perturb.humanized("t", "none")
    assert one(spark, perturb.humanized("t"), t, None)[1] is None
