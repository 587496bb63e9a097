from pyspark.sql import functions as F

import corpus_pipeline as cp
from lectern.llm import divergence, simhash, toxicity
from tests.llm.test_minhash import slow_kept

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "packing"]
    left = {r.doc_id: r.text for r in docs.collect()}
    verdict = {r.doc_id for r in divergence.quality(docs).where("kept").collect()}
    left = {d: t for d, t in left.items() if d in verdict}
    rows = docs.where(F.col("doc_id").isin(list(left)))
    model = toxicity.fit(rows, spark.read.parquet(f"{SF}/labels.parquet"))
    tame = {r.doc_id for r in toxicity.scored(rows, model).where("predicted = 0").collect()}
    left = {d: t for d, t in left.items() if d in tame}
    # The stage's own rule: five words, a similarity of 0.8; three words and 2 bits are op4's contract.
    want = slow_kept(list(left.items()))
    got = cp.run(spark, SF)
    assert sorted(r.doc_id for r in got.where("piece = 0").collect()) == want and 0 < len(want) < docs.count()


def test_stages_keep_the_columns_and_take_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (3, "same words here " * 40, "en", "s", 5), (3, "same words here " * 40, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert simhash.one_of_each(docs).where("doc_id = 3").count() == 1


def test_no_labels_and_repeated_ids_lose_no_document(spark, tmp_path):
    """One id with two texts, and a labels table without rows: what is left differs from the input by copies alone."""
    text = lambda i: " ".join(f"plain{j} words{(i * 7 + j) % 40}" for j in range(40))
    rows = [(i // 2, text(i), "en", "s", 9) for i in range(20)] + [(3, text(6), "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tame = cp.toxicity_filter(spark, docs, str(tmp_path))
    assert tame.count() == 21
    left = cp.near_duplicates(spark, tame, str(tmp_path))
    assert sorted(tuple(r) for r in left.collect()) == sorted(set(rows))
