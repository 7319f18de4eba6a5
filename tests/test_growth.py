"""What grows faster than the input: rows that are shuffled, values that are worked out again, tables that are broadcast."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays
from plumbline.operators import ordered, pairs, refs, retrieval, similarity, vectors


def shuffled(spark, run):
    """(result, shuffled rows) of run()."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    s = stages()
    last = max((s.apply(i).stageId() for i in range(s.size())), default=-1)
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    s = stages()
    return out, sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()) if s.apply(i).stageId() > last)


def groups(spark, of):
    return spark.createDataFrame([(s, g, [float(x) for x in vs], len(vs)) for s, g, vs in of], "source string, group_key string, vals array<double>, n long")


def test_stored_tables_are_not_broadcast(spark):
    """a stored table's file is far smaller than its rows."""
    out = pairs.shares_within_source(groups(spark, [("s", "a", [1, 2, 3, 4]), ("s", "b", [2, 3, 4])]))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and [r["kind"] for r in out.collect()] == ["endpoint_dropout"]


def test_one_title_for_many(spark):
    """equal titles of a year meet once, not entry by file."""
    rows = lambda name, n: spark.range(n).select(F.concat(F.lit(name), "id").alias(name), F.when(F.col("id") == 0, "d").alias("doi"), F.lit(2001).alias("year"), F.lit("growth of small flies").alias("title"))
    out, n = shuffled(spark, lambda: refs.matched_by_priority(rows("entry", 300), rows("file", 300)).collect())
    assert sorted((r["status"], r["rule"]) for r in out) == [("ambiguous", 2)] * 299 + [("matched", 1)] and n < 5000


def test_multisets_of_few_values(spark):
    """F8: a vector is its different values with their counts."""
    v = groups(spark, [("s", "a", [1] * 900 + [2] * 100), ("s", "b", [1] * 500 + [3] * 100), ("s", "c", [3] * 700)])
    out, n = shuffled(spark, lambda: pairs.multiset_overlaps(v, 0.5).collect())
    assert [tuple(r) for r in out] == [("s", "a", "b", 500)] and n < 200


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_dense_and_long_sets(spark, threshold):
    """sets that hold nearly all values meet by what they lack; all pairs are those of brute force."""
    rng = np.random.default_rng(3)
    sets = [set(range(50)) - set(rng.choice(50, k, replace=False).tolist()) for k in rng.choice([0, 1, 2, 2, 3, 5], 600)]
    long = [set(rng.choice(range(100, 2000), 90, replace=False).tolist()) for _ in range(5)]
    sets += long + [s - {min(s)} for s in long] + [s | {5000 + i for i in range(4)} for s in long] + [set(range(k, k + 6)) for k in range(0, 8, 3)]
    obs = spark.createDataFrame([("s", f"g{i}", float(x)) for i, s in enumerate(sets) for x in s], "source string, group_key string, value double")
    members, found = pairs.similar_sets(obs, threshold)
    of = {r["set_id"]: sets[int(r["group_key"][1:])] for r in members.collect()}
    want = {(a, b) for a in of for b in of if a < b and len(of[a] & of[b]) >= threshold * len(of[a] | of[b]) - 1e-12}
    got, n = shuffled(spark, lambda: [(r["set_a"], r["set_b"]) for r in found.collect()])
    assert set(got) == want and len(got) == len(want)
    assert threshold < 0.9 or n < 30000


def test_multiples_near_an_edge(spark):
    """vectors stand in one band, near its edge in two; multiples meet wherever they lie."""
    v = groups(spark, [("e", "a", [1, 4]), ("e", "b", [3, 12.00001]), ("e", "c", [2, 8.000004])] + [(f"s{i}", g, [1, 2 + i]) for i in range(100) for g in "a"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, n = shuffled(spark, lambda: pairs.ratios_within_source(v, 2).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["group_a"], r["group_b"], r["k"]) for r in out} == {("a", "b", 3), ("a", "c", 2)} and n < 600


def test_scores_of_a_block_are_held_in_parts(spark):
    """what a task holds at once has a bound below its block."""
    assert similarity.SCORES * 8 <= 2**24
    x = np.random.default_rng(1).random((200, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    old, similarity.SCORES = similarity.SCORES, 900
    try:
        got = {(r["query"], r["id"]) for r in similarity.top_k(df.filter("id < 30"), df, 2).collect()}
    finally:
        similarity.SCORES = old
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[:30] @ u.T
    s[np.arange(30), np.arange(30)] = -2
    assert got == {(i, int(j)) for i in range(30) for j in np.argsort(-s[i])[:2]}


def test_islands_in_one_sort(spark):
    """repeated and null numbers count once; no hash tables."""
    df = spark.createDataFrame([(1, x) for x in (1, 2, 2, 4, 9, 9, None, None)] + [(2, 5), (2, 5), (None, 3)], "k int, x int")
    out = ordered.islands(df, ["k"], "x", 2)
    assert {tuple(r) for r in out.collect()} == {(1, None, None, 1), (1, 1, 4, 3), (1, 9, 9, 1), (2, 5, 5, 1), (None, 3, 3, 1)}
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_only_asked_words_are_shuffled(spark):
    """other words of the documents are counted where they are read."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100)) + " flies") for i in range(20)] + [(20, None), (21, "")], "doc long, text string")
    q = spark.sql("SELECT 1L AS query, 'small flies' AS text")
    out, n = shuffled(spark, lambda: retrieval.bm25(q, docs).collect())
    assert [(r["rank"], r["doc"]) for r in out] == [(1, 0), (2, 1), (3, 2)] and n < 500


def test_values_of_a_row_are_worked_out_once(spark):
    """a mean or a sum is not worked out again for every value."""
    n = 12000
    v = spark.sql(f"SELECT 's' AS source, 'g' AS group_key, transform(sequence(0, {n - 1}), x -> double(x)) AS vals, {n}L AS n")
    stated = spark.createDataFrame([("s", "g", 1.0, "1.0")], "source string, group_key string, stated double, printed string")
    began = time.time()
    assert vectors.check_means(v, stated).first()["status"] == "unexplained"
    assert v.select(arrays.z_similarity(F.col("vals"), F.col("vals"))).first()[0] == 1.0
    assert v.select(arrays.integer_ratio(F.col("vals"), F.transform("vals", lambda x: x * 3))).first()[0] == 3
    assert time.time() - began < 20
