import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embed, joins, similarity


def unit(m):
    m = np.asarray(m, dtype=np.float32).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def clustered(seed, n, dim=8, hot=0):
    """Tight clusters plus ``hot`` exact copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    m = centres[rng.integers(0, 6, n)] + 0.15 * rng.normal(size=(n, dim))
    if hot:
        m[:hot] = m[0]
    return m.astype(np.float32)


def frame(spark, m, start=0):
    return spark.createDataFrame(
        [(start + i, [float(x) for x in v]) for i, v in enumerate(m)], "id BIGINT, embedding ARRAY<FLOAT>"
    ).repartition(4)


PLANS = [{}, {"max_bytes": 0, "pivots": 5, "block": 16}, {"max_bytes": 0, "block": 8}]


@pytest.mark.parametrize("plan", PLANS)
def test_self_similarity_against_all_pairs(spark, plan):
    m = clustered(1, 120, hot=40)
    sims = unit(m) @ unit(m).T
    np.fill_diagonal(sims, -np.inf)
    want = np.sort(sims, axis=1)[:, ::-1][:, :5].mean(axis=1)
    rows = similarity.knn_self_similarity(frame(spark, m), 5, **plan).collect()
    assert len(rows) == 120
    for r in rows:
        assert r["inter_review_sim_topk"] == pytest.approx(want[r["id"]], abs=1e-9)


@pytest.mark.parametrize("plan", PLANS)
def test_realism_against_all_pairs(spark, plan):
    gen, real = clustered(2, 60, hot=20), clustered(3, 90, hot=30)
    sims = np.sort(unit(gen) @ unit(real).T, axis=1)[:, ::-1]
    rows = similarity.knn_realism(frame(spark, gen), frame(spark, real, 1000), 4, **plan).collect()
    assert len(rows) == 60
    for r in rows:
        assert r["realism_sbert_topk"] == pytest.approx(sims[r["id"], :4].mean(), abs=1e-9)
        assert r["nn_overlap"] == pytest.approx(sims[r["id"], 0], abs=1e-9)
        assert r["nn_overlap_flag"] == int(r["nn_overlap"] >= 0.9)


@pytest.mark.parametrize("plan", PLANS)
def test_twins_see_each_other_and_not_themselves(spark, plan):
    m = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]
    got = {r["id"]: r["inter_review_sim_topk"] for r in
           similarity.knn_self_similarity(frame(spark, m), 1, **plan).collect()}
    assert got == pytest.approx({0: 1.0, 1: 1.0, 2: 0.0, 3: 0.0})


def test_too_few_rows(spark):
    df = frame(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    with pytest.raises(ValueError, match="too few"):
        similarity.knn_self_similarity(df, 3)
    with pytest.raises(ValueError, match="too few"):
        similarity.knn_realism(df, df, 4)
    with pytest.raises(ValueError, match="at least 1"):
        similarity.knn_realism(df, df, 0)


def test_far_cells_are_not_visited(spark):
    """Two opposite tight groups: no block of one meets a query of the other."""
    m = np.vstack([[1, 0, 0] + 0.01 * np.random.default_rng(5).normal(size=(30, 3)),
                   [-1, 0, 0] + 0.01 * np.random.default_rng(6).normal(size=(30, 3))]).astype(np.float32)
    df = frame(spark, m)
    cells = similarity._Cells(similarity._distinct(df, "id", "embedding", 6), 8, 16)
    asked = cells.homed.withColumn("_reach", F.lit(0.2))
    side = {r["_rep"]: r["_cell"] for r in cells.homed.collect()}
    left = {side[i] for i in range(30)}
    for r in cells.reachable(asked).collect():
        assert (r["_rep"] < 30) == (r["_cell"] in left)


def many_clusters(seed, n, size=40, dim=16):
    """Tight clusters of about ``size`` vectors each, so more vectors are more clusters."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // size, dim))
    return (centres[rng.integers(0, n // size, n)] + 0.02 * rng.normal(size=(n, dim))).astype(np.float32)


def leaf_pairs(spark, m, k=3, block=64):
    """Query-leaf visits behind a self join, per query, and the largest leaf."""
    df = frame(spark, m)
    cells = similarity._Cells(similarity._distinct(df, "id", "embedding", k + 1), None, block)
    near = similarity._merge(similarity._best_in_blocks(cells.meet(cells.own_visits(cells.homed)), k, True, "bigint"), k)
    visits = cells.reachable(similarity._reaching(cells, cells.homed, near, k)).count()
    return visits / len(m), cells.leaves.agg(F.max("n")).first()[0]


def test_visits_do_not_grow_with_clustered_data(spark):
    small, big = leaf_pairs(spark, many_clusters(1, 1_000)), leaf_pairs(spark, many_clusters(2, 4_000))
    assert big[0] < 1.5 * small[0] + 1 and big[0] < 12  # of 4,000 / 16 = 250 leaves
    assert max(small[1], big[1]) < 64 * 4


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_tree_equals_broadcast(spark, kind):
    m = many_clusters(3, 900) if kind == "clustered" else np.random.default_rng(4).normal(size=(600, 6)).astype(np.float32)
    m[50:90] = m[50]
    df = frame(spark, m)
    plain = {r["id"]: r["inter_review_sim_topk"] for r in similarity.knn_self_similarity(df, 4).collect()}
    tree = {r["id"]: r["inter_review_sim_topk"] for r in similarity.knn_self_similarity(df, 4, max_bytes=0, block=64).collect()}
    assert tree == pytest.approx(plain, abs=1e-9) and len(tree) == len(m)


def test_overlap_pairs(spark):
    gen = clustered(7, 50, hot=15)
    real = np.vstack([clustered(8, 60, hot=20), gen[:3], gen[20:25]])
    sims = unit(gen) @ unit(real).T
    rows = similarity.overlap_pairs(
        frame(spark, gen), frame(spark, real, 1000), 0.9, pivots=6, block=16
    ).collect()
    first_gen = {tuple(v): min(i for i, w in enumerate(gen) if tuple(w) == tuple(v)) for v in gen}
    first_real = {tuple(v): min(i for i, w in enumerate(real) if tuple(w) == tuple(v)) for v in real}
    want = {
        (first_gen[tuple(gen[i])], 1000 + first_real[tuple(real[j])])
        for i, j in zip(*np.nonzero(sims >= 0.9))
    }
    assert {(r["gen_id"], r["real_id"]) for r in rows} == want and len(rows) == len(want)
    assert sum(r["gen_copies"] * r["real_copies"] for r in rows) == int((sims >= 0.9).sum())


def test_anchors(spark):
    df = frame(spark, [[1.0, 0.1], [0.1, 1.0], [1.0, 1.0]])
    anchors = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "anchor_pos ARRAY<FLOAT>, anchor_neg ARRAY<FLOAT>")
    got = {r["id"]: r["prediction"] for r in joins.anchor_classify(df, "embedding", anchors).collect()}
    assert got == {0: "POSITIVE", 1: "NEGATIVE", 2: "NEGATIVE"}


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, None), (3, "B a B")], "id INT, t STRING")
    got = {r["id"]: r["embedding"] for r in embed.embed(df, "t").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-6)
    assert got[1] == got[3] and set(got[2]) == {0.0}


def test_embed_with_own_encoder(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "id INT, t STRING")
    make = lambda: lambda texts: np.array([[len(t), 0.0] for t in texts])
    rows = embed.embed(df, "t", make, batch_size=2).collect()
    assert all(r["embedding"] == [1.0, 0.0] for r in rows)


def unstructured(seed, n, dim=24):
    m = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    m[n // 2 : n // 2 + 20] = m[n // 2]
    return m


def test_unstructured_vectors_meet_in_a_grid(spark):
    """Where nothing can be skipped a query moves once per pack of targets and not once per leaf."""
    m = unstructured(11, 1_200)
    cells = similarity._Cells(similarity._distinct(frame(spark, m), "id", "embedding", 6), 8, 64)
    asked = cells.homed.withColumn("_reach", F.lit(1.4))
    assert cells.dense(asked)
    moved = cells.grid(asked, ["_reach"]).agg(F.sum(F.size("q_rep"))).first()[0]
    assert moved <= 16 * len(m) and moved < cells.reachable(asked).count()
    tight = similarity._Cells(similarity._distinct(frame(spark, many_clusters(12, 2_000)), "id", "embedding", 6), None, 64)
    assert not tight.dense(tight.homed.withColumn("_reach", F.lit(0.1)))


def test_grid_equals_all_pairs(spark):
    m, other = unstructured(13, 700), unstructured(14, 500)
    other[:5] = m[:5]
    plan = {"max_bytes": 0, "pivots": 8, "block": 64}
    sims = unit(m) @ unit(m).T
    np.fill_diagonal(sims, -np.inf)
    want = np.sort(sims, axis=1)[:, ::-1][:, :5].mean(axis=1)
    rows = similarity.knn_self_similarity(frame(spark, m), 5, **plan).collect()
    assert {r["id"]: r["inter_review_sim_topk"] for r in rows} == pytest.approx(dict(enumerate(want)), abs=1e-9)
    sims = unit(other) @ unit(m).T
    want = np.sort(sims, axis=1)[:, ::-1][:, :5].mean(axis=1)
    rows = similarity.knn_realism(frame(spark, other), frame(spark, m, 5_000), 5, **plan).collect()
    assert {r["id"]: r["realism_sbert_topk"] for r in rows} == pytest.approx(dict(enumerate(want)), abs=1e-9)
    pairs = similarity.overlap_pairs(frame(spark, other), frame(spark, m, 5_000), 0.3, pivots=8, block=64).collect()
    assert sum(r["gen_copies"] * r["real_copies"] for r in pairs) == int((sims >= 0.3).sum())
    assert all(r["similarity"] == pytest.approx(sims[r["gen_id"], r["real_id"] - 5_000], abs=1e-9) for r in pairs)
