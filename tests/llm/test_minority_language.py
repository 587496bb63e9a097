"""Documents of a language with little of the corpus are judged by their own language or not by distance."""

import random

from lectern.llm import divergence


def texts(prefix, n, seed):
    rng = random.Random(seed)
    words = [f"{prefix}{chr(97 + i)}" for i in range(20)] + [f"{prefix}{i:x}qu" for i in range(400)]
    return [" ".join(rng.choices(words, [20] * 20 + [1] * 400, k=200)) for _ in range(n)]


def rows(spark, small):
    docs = [(t, "aa") for t in texts("b", 3000, 1)] + [(t, "zz") for t in texts("k", small, 2)]
    return spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(docs)], "doc_id long, text string, lang string")


def test_a_language_below_the_share_has_a_reference(spark):
    docs = rows(spark, 40)  # 8,000 words, 1.3 % of all
    assert set(divergence.build_references(docs).words) == {"aa", "zz"}
    assert divergence.kept(docs).where("lang = 'zz'").count() == 40


def test_a_language_without_a_reference_is_not_judged_by_distance(spark):
    docs = rows(spark, 5)
    assert set(divergence.build_references(docs).words) == {"aa"}
    got = divergence.quality(docs).where("doc_id >= 3000").collect()
    assert len(got) == 5 and all(r.kept and r.word_distance is None and r.char_distance is None for r in got)
    assert divergence.kept(docs).where("lang = 'zz'").count() == 5
