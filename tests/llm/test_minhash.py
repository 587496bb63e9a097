"""The pipeline's near-duplicate stage against brute force over the exact Jaccard similarity."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from lectern.llm import minhash, simhash
from tests.llm.test_operators import slow_components

SF = "/root/testdata/sf0.01"


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def slow_kept(rows):
    sets = {s: i for i, s in enumerate(sorted({slow_shingles(t) for _, t in rows}, key=sorted))}
    of = slow_components(list(sets.values()), lambda a, b, by=list(sets): alike(by[a], by[b]))
    groups = defaultdict(list)
    for d, t in rows:
        groups[of[sets[slow_shingles(t)]]].append(d)
    return sorted(min(g) for g in groups.values())


def test_stage_takes_near_copies_at_any_simhash_distance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = cp.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("most", [3, 4096])
def test_stage_links_a_crowded_family_as_brute_force_does(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "LIST", most)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # one to nine words changed: pairs on both sides of the limit, in crowded buckets
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 10)), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == slow_kept(rows)


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    long = "a text of some words that has more than five of them"
    rows = [(None, long), (None, long), (None, "other words " * 9), (7, "first text under one id " * 2), (7, "second and wholly unlike passage here now"), (8, long), (9, ""), (9, None)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, "other words " * 9), (7, rows[3][1]), (7, rows[4][1]), (8, long), (9, "")])


def test_a_family_without_links_makes_few_pairs(spark, monkeypatch):
    """400 texts alike their common source, hardly any of them alike enough each other: brute force's rows, and no square of pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(300, int(rng.integers(8, 14)), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    for i in range(0, 40, 4):  # and copies of some with one more word: links that must be found
        rows.append((400 + i, f"{rows[i][1]} y{i}"))
    met, whole = [], minhash.verified

    def counted(pairs, *more):
        met.append(pairs.count())
        return whole(pairs, *more)

    monkeypatch.setattr(minhash, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == slow_kept(rows)
    assert sum(met) < 10 * len(rows)


@pytest.mark.parametrize("limit", [0.5, 0.8, 0.95])
def test_differences_to_any_hub_lose_no_pair(spark, limit):
    """Sets of all sizes and distances, the hub any of them: every pair at the limit is there, unless both are alike the hub."""
    rng = np.random.default_rng(7)
    texts, sets = {}, {}
    for i in range(160):
        words = [f"w{j}" for j in range(int(rng.integers(40, 70)))]
        for at in rng.choice(len(words), int(rng.integers(0, 6)), replace=False):
            words[at] = f"x{int(rng.integers(0, 9))}"
        texts[i], sets[i] = " ".join(words), minhash.shingles(" ".join(words).encode())
    for hub in (0, 1, 2):
        pairs = spark.createDataFrame([(hub, i, i) for i in texts if i != hub], "u long, v long, root long")
        apart = minhash.differences(pairs, spark.createDataFrame(list(texts.items()), "node long, text string"), limit=limit)
        near = {i for i in texts if minhash.similarity(sets[hub], sets[i]) >= limit}
        want = {(i, j) for i in texts for j in texts if i < j and hub not in (i, j) and not {i, j} <= near and minhash.similarity(sets[i], sets[j]) >= limit}
        got = {(min(r), max(r)) for r in minhash._across(apart, limit).collect()}
        assert want and want <= got
        assert {r.v for r in apart.where("near").collect()} == near - {hub}
