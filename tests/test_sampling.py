from hashlib import md5

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, sampling


def order(i):
    return md5(f"42|{i}".encode()).hexdigest(), i


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds two thirds of the rows, one is tiny, one has a NULL key."""
    data = [(i, "hot") for i in range(600)] + [(i, "cold") for i in range(600, 610)]
    data += [(i, None) for i in range(610, 690)]
    return spark.createDataFrame(data, "id BIGINT, g STRING").repartition(7).cache(), data


def expected(data, n):
    groups = {}
    for i, g in data:
        groups.setdefault(g, []).append(i)
    return {i for ids in groups.values() for i in sorted(ids, key=order)[:n]}


@pytest.mark.parametrize("n", [1, 10, 50, 60, 599, 600, 5000])
def test_sample_per_group(rows, n):
    df, data = rows
    got = [r["id"] for r in sampling.sample_per_group(df, ["g"], n, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == expected(data, n)


@pytest.mark.parametrize("n", [1, 100, 689, 690, 10_000])
def test_sample_n(rows, n):
    df, data = rows
    got = {r["id"] for r in sampling.sample_n(df, n, "id").collect()}
    assert got == set(sorted([i for i, _ in data], key=order)[:n])


def test_sample_zero_means_all(rows):
    assert sampling.sample_n(rows[0], 0, "id").count() == 690


def test_sample_does_not_depend_on_partitions(rows):
    df, _ = rows
    a = {r["id"] for r in sampling.sample_n(df.repartition(3), 77, "id").collect()}
    assert a == {r["id"] for r in sampling.sample_n(df.coalesce(1), 77, "id").collect()}


def test_many_groups_stay_distributed(spark, monkeypatch):
    from corpusloom import sizing

    df = spark.range(500).select("id", (F.col("id") % 100).alias("g"))
    want = {r["id"] for r in sampling.sample_per_group(df, ["g"], 3, "id").collect()}
    monkeypatch.setattr(sizing, "MAX_DRIVER_ROWS", 5)
    monkeypatch.setattr(sampling, "local_if_small", lambda d: sizing.local_if_small(d, 5))
    got = {r["id"] for r in sampling.sample_per_group(df, ["g"], 3, "id").collect()}
    assert got == want and len(got) == 300


def test_exact_split_of_eleven(spark):
    df = sampling.split_exact(spark.range(11), "id")
    got = {r["id"] for r in df.filter("is_test").collect()}
    assert got == set(sorted(range(11), key=order)[:2]) and df.count() == 11


def test_hash_split_is_disjoint_and_near_a_tenth(spark):
    df = spark.range(5000).withColumn("is_test", sampling.split_flag("id"))
    assert 400 < df.filter("is_test").count() < 600
    assert df.filter("is_test is null").count() == 0


def test_stratified_numbers_in_order(rows):
    df, data = rows
    got = sampling.stratified(df, "g", 20, "id", ["cold", "hot"]).orderBy("temp_id").collect()
    assert [r["temp_id"] for r in got] == list(range(30))
    assert [r["g"] for r in got] == ["cold"] * 10 + ["hot"] * 20
    assert [r["id"] for r in got[10:]] == sorted(range(600), key=order)[:20]


@pytest.mark.parametrize("n", [1, 25, 2000])
def test_cap_per_key(rows, n):
    df, data = rows
    got = {r["id"] for r in sampling.cap_per_key(df, "g", ["id"], n, salts=5).collect()}
    groups = {}
    for i, g in data:
        groups.setdefault(g, []).append(i)
    assert got == {i for ids in groups.values() for i in sorted(ids)[:n]}


def test_dense_id_over_ranges(rows):
    df, data = rows
    got = sampling.dense_id(df, ["g", "id"], start=1).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(1, 691))
    assert [r["id"] for r in got] == [i for i, g in sorted(data, key=lambda x: (x[1] or "", x[0]))]


def test_dedup_first(spark):
    data = [(1, 5, "same"), (2, 5, "same"), (3, 6, "same"), (4, 5, "other")]
    data += [(i, 7, "copy") for i in range(10, 200)]
    df = spark.createDataFrame(data, "id INT, app_id INT, review_text STRING").repartition(4)
    for text_col in (None, "review_text"):
        got = dedup.dedup_first(df, ["app_id", "review_text"], "id", text_col)
        assert sorted(r["id"] for r in got.collect()) == [1, 3, 4, 10]


def test_dedup_limits_groups_before_the_shuffle(spark, capsys):
    df = spark.range(10).select("id", (F.col("id") % 3).alias("app_id"))
    dedup.dedup_first(df, ["app_id"], "id").explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_small_quotas_take_the_same_rows_in_one_scan(rows):
    df, _ = rows
    want = sampling._take_lowest(df, ["g"], "id", sampling.SEED, lambda total: F.lit(7))
    got = sampling.sample_per_group(df.repartition(9), ["g"], 7, "id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and plan.count("WindowGroupLimit") == 2
