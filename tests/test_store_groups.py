from pyspark.sql import functions as F

from lectern import store as module
from lectern.store import Store


def rows(spark, editions, chapter="c"):
    return spark.range(1, 3).crossJoin(spark.createDataFrame([(e,) for e in editions], "edition_id long")).select(
        (F.col("edition_id") * 10 + F.col("id")).alias("id"), "edition_id", F.col("id").cast("int").alias("seq"), F.lit(chapter).alias("chapter"), F.lit(None).cast("int").alias("page"), F.lit("text").alias("content"), F.lit(" text ").alias("tok")
    )


def held(store, version=None):
    return {(r[0], r[1], r[2]) for r in store.table("segments", version).groupBy("edition_id", "chapter").count().collect()}


def test_a_whole_table_is_not_rewritten_for_an_edition(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"segments": rows(spark, range(1, 6))}, 0)
    first = store.tables()["segments"][0]["folder"]
    folders = lambda: [g["folder"] for g in store.tables()["segments"]]
    store.commit({}, 1, {3: None})
    assert folders() == [first] and held(store) == {(e, "c", 2) for e in (1, 2, 4, 5)} and store.edition(3).isEmpty()
    store.commit({}, 2, {5: rows(spark, [5], "new")})
    assert folders()[0] == first and len(folders()) == 2
    assert held(store) == {(1, "c", 2), (2, "c", 2), (4, "c", 2), (5, "new", 2)} and store.edition(5).where("chapter = 'new'").count() == store.edition(5).count() == 2
    store.commit({}, 3, {5: store.edition(5).where("seq = 1"), 3: rows(spark, [3], "back")})
    assert folders()[0] == first and held(store) == {(1, "c", 2), (2, "c", 2), (4, "c", 2), (5, "new", 1), (3, "back", 2)}
    monkeypatch.setattr(module, "MOST_GONE", 2)
    store.commit({}, 4, {1: None})
    assert first not in folders() and not any(g.get("gone") for g in store.tables()["segments"])
    assert held(store) == {(2, "c", 2), (4, "c", 2), (5, "new", 1), (3, "back", 2)}
    assert held(store, 1) == {(e, "c", 2) for e in range(1, 6)} and held(store, 2) == {(e, "c", 2) for e in (1, 2, 4, 5)}


def test_a_group_of_many_counted_editions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "FEW", 2)
    store = Store(spark, str(tmp_path / "store"))
    store.commit({}, 0, {e: rows(spark, [e]) for e in range(1, 5)})
    store.merge()
    merged = store.tables()["segments"]
    store.commit({}, 2, {2: None})
    assert store.tables()["segments"] == [merged[0] | {"editions": [1, 3, 4], "gone": [2]}] and held(store) == {(e, "c", 2) for e in (1, 3, 4)}
    store.commit({}, 3, {5: rows(spark, [5])})
    store.merge()
    assert [g["editions"] for g in store.tables()["segments"]] == [[1, 3, 4, 5]] and held(store) == {(e, "c", 2) for e in (1, 3, 4, 5)}
