"""Vector operators against brute force, components against union-find, and the pipeline against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basisflow.llm import ann, embed_dedup
from basisflow.llm.graph import components, local_components
from tests.llm.samples import groups


def vectors(n=400, dim=16, seed=3):
    """Clusters with near copies, exact copies, scaled copies, null, zero and non-finite rows, other lengths, null labels and ids."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, dim))
    out = [(i, (centers[i % 20] + rng.normal(size=dim) * (0.15 if i % 3 else 2)).tolist(), i % 4 if i % 11 else 1) for i in range(n)]
    out += [(n + i, out[i][1], out[i][2]) for i in range(0, 30, 3)]
    out += [(n + 40 + i, [2 * x for x in out[i][1]], out[i][2]) for i in range(0, 9)]
    out += [(n + 60, None, 1), (n + 61, [0.0] * dim, 1), (n + 62, [float("nan")] + [1.0] * (dim - 1), 1), (n + 63, [float("inf")] + [1.0] * (dim - 1), 1),
            (n + 64, [None] + [1.0] * (dim - 1), 1), (n + 65, [1.0] * (dim - 1), 1), (n + 66, out[0][1], None), (None, out[0][1], 1), (n + 67, [1e-30] * dim, 1), (n + 68, [1e30] * dim, 1),
            (5, out[5][1], out[5][2])]
    return out


SCHEMA = "vec_id long, embedding array<double>, label int"


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("tile", [2048, 40])
def test_embedding_dedup_is_exact(spark, tile):
    data = vectors()
    valid = {i: (np.array(v), c) for i, v, c in data if i is not None and good(v) and c is not None}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, (v, _) in valid.items()}
    links = [(a, b) for a in unit for b in unit if a < b and valid[a][1] == valid[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    want, n = groups({i for i, _, _ in data if i is not None}, links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    df = spark.createDataFrame(data, SCHEMA).withColumn("n_links", F.lit("clash")).repartition(3)
    out = embed_dedup.near_duplicates(df, tile=tile).collect()
    assert len(out) == len({i for i, _, _ in data}) and len(links) > 300
    for r in out:
        assert (r.n_links, r.component_id) == ((n.get(r.vec_id, 0), want[r.vec_id]) if r.vec_id is not None else (0, None))
        assert r.kept == (r.vec_id == r.component_id)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2048, 7])
def test_embedding_dedup_of_repeated_ids(spark, tile):
    """Ids with several different rows: another id counts once, and components end at the smallest id."""
    data = [(1, [1.0, 0.0], 1), (1, [1.0, 0.05], 1), (2, [1.0, 0.02], 1), (9, [0.0, 1.0], 1), (9, [1.0, 0.01], 1), (9, [0.0, 1.0], 2), (4, [0.01, 1.0], 1),
            (5, [0.0, 1.0], 2), (3, [0.0, 1.0], 2), (7, [-1.0, 0.0], 1), (7, [-1.0, 0.0], 2), (6, [-1.0, 0.001], 2), (8, [-1.0, -0.001], 2), (8, [-1.0, -0.001], 2), (11, [3.0, 3.0], 1)]
    rng = np.random.default_rng(8)
    data += [(int(i), (np.array(c) + rng.normal(size=2) * 0.1).tolist(), 3) for i in rng.integers(20, 60, 120) for c in [rng.choice([-1.0, 0.0, 1.0], 2) * 3 + 0.01]]
    near = lambda v, w: v[1] == w[1] and np.dot(v[0], w[0]) / np.linalg.norm(v[0]) / np.linalg.norm(w[0]) >= 0.93
    of = {}
    for i, v, c in data:
        of.setdefault(i, []).append((v, c))
    links = [(a, b) for a in of for b in of if a < b and any(near(v, w) for v in of[a] for w in of[b])]
    want = groups(set(of), links)
    out = embed_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3), tile=tile).collect()
    assert len(out) == len(of)
    for r in out:
        assert (r.vec_id, r.n_links) == (r.vec_id, sum(r.vec_id in x for x in links))
        assert (r.component_id, r.kept) == (want[r.vec_id], r.vec_id == want[r.vec_id])


def test_int8_bound_is_rigorous():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24)) * 10.0 ** rng.integers(-12, 12, (300, 1))
    q, s, n, e = embed_dedup.quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    gap = np.abs(u @ u.T - (q.astype(float) @ q.T.astype(float)) * np.outer(s, s))
    assert (gap <= np.outer(e, n + e) + np.outer(n, e) + 1e-12).all()


def brute(data, queries, k):
    rows = [(i, np.array(v)) for i, v, _ in data if i is not None and good(v) and len(v) == 16]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out = {}
    for q, v in [(i, v) for i, v in rows if i in queries]:
        s = (x * v).sum(1)
        keep = ids != q
        order = np.lexsort([ids[keep], -s[keep]])[:k]
        out[q] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def test_nearest_neighbours_recall_and_scores(spark):
    data = [r for r in vectors(3000) if r[0] is None or r[0] != 3068]  # without the one that outweighs all
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    index = ann.build(df, leaf_rows=32)
    assert index.tree.n_leaves > 30 and index.visits < index.tree.n_leaves
    assert index.rows.select("id").distinct().count() == len({i for i, v, _ in data if i is not None and good(v) and len(v) == 16})
    queries = df.where("vec_id % 20 = 0")
    out = ann.search(index, queries).collect()
    want = brute(data, {i for i, _, _ in data if i is not None and i % 20 == 0}, 20)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == 20
        exact = dict(brute(data, {q}, 10**6)[q])
        assert all(abs(exact[v] - s) < 1e-9 for v, s in near)


def test_each_length_of_vectors_has_an_index(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=(3, 5)[i % 7 == 0]).tolist(), 0) for i in range(200)] + [(220, [1.0], 0), (240, None, 0)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    out = ann.search_all(ann.build_all(df), df.where("vec_id % 20 = 0"), k=6).collect()
    asked = {i: np.array(v) for i, v, _ in data if i % 20 == 0 and v}
    want = {(q, v) for q, x in asked.items() for v in sorted((i for i, w, _ in data if w and i != q and len(w) == len(x)),
                                                              key=lambda i: (-float(x @ np.array(data[i][1])), i))[:6]}
    assert {(r.query_id, r.vec_id) for r in out} == want and 220 not in {r.query_id for r in out}
    assert ann.search_all(ann.build_all(df.limit(0)), df).count() == 0


def test_queries_in_tiny_leaves_find_k(spark):
    df = spark.createDataFrame([r for r in vectors(600) if r[1] and len(r[1]) == 16], SCHEMA)
    index = ann.build(df, leaf_rows=8)
    index.visits = 1
    assert index.rows.groupBy("leaf").count().agg(F.min("count")).first()[0] < 20
    out = ann.search(index, df.where("vec_id % 20 = 0"))
    assert {r["count"] for r in out.groupBy("query_id").count().collect()} == {20}


def test_queries_in_rounds_find_the_same_and_rows_stay_where_they_lie(spark, monkeypatch):
    """One vector has 300 copies. No plan joins queries with rows or gathers rows of a leaf: a query crosses once for each round, not once for each leaf."""
    data = vectors(1500)
    data += [(5000 + i, data[20][1], 0) for i in range(300)] + [(40, data[20][1], 0), (40, data[60][1], 0)]
    df = spark.createDataFrame([r for r in data if r[0] is None or r[0] != 1568], SCHEMA).repartition(3)
    index, asked = ann.build(df, leaf_rows=32), df.where("vec_id % 20 = 0")
    index.visits = index.tree.n_leaves
    rows = lambda: sorted(map(tuple, ann.search(index, asked).collect()))
    at_once = rows()
    plan = ann.search(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan
    monkeypatch.setattr(ann, "CHUNK", 30)
    assert rows() == at_once
    want = brute([r for r in data if r[0] != 1568], {i for i, _, _ in data if i is not None and i % 20 == 0 and i != 40}, 20)
    got = {}
    for q, _, v, s in at_once:
        got.setdefault(q, []).append((v, round(s, 9)))
    assert all([(v, round(s, 9)) for v, s in want[q]] == got[q] for q in want)


def test_sample_is_that_of_the_smallest_hashes(spark):
    df = spark.range(5000).selectExpr("id", "array(double(id)) AS v").union(spark.range(3).selectExpr("7L", "array(1D)"))
    hashed = F.xxhash64(F.lit("s"), "id")
    for n in (5, 400, 6000):
        want = [r.id for r in df.orderBy(hashed, "id").limit(n).collect()]
        assert ann._smallest(df, "s", n, 5003)["id"].to_pylist() == want


def test_few_or_no_vectors(spark):
    data = [(20, [1.0, 2.0], 0), (21, [1.0, 2.0], 0), (22, [1.0, 2.0], 0), (23, [3.0, 0.0], 0)]
    df = spark.createDataFrame(data, SCHEMA)
    out = ann.search(ann.build(df), df.where("vec_id % 20 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(20, 1, 21, 5.0), (20, 2, 22, 5.0), (20, 3, 23, 3.0)]
    assert ann.build(df.limit(0)) is None


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(9)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 7), (None, 3)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(70)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = groups({x for p in real for x in p}, real)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array([x for x, _ in real]), np.array([x for _, x in real])
    low = local_components(500, a, b)
    assert all(low[x] == r for x, r in want.items())


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    """Scores come from the operator itself; what the stages decide and hand on is worked out again."""
    import corpus_pipeline as cp
    from basisflow.llm import line_dedup, quality
    from tests.llm.samples import shingles

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    state = {r.doc_id: r.text for r in quality.score(docs, model).where("score >= 0.3").collect()}
    now = docs
    for name, stage in cp.STAGES[:4]:
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        kept = {r.doc_id: r.text for r in after.collect()}
        if name.startswith("quality"):
            assert kept == state
        elif name.startswith("line"):
            lean = {r.doc_id: r.text for r in line_dedup.dedup(now).collect()}
            assert kept == {k: t for k, t in lean.items() if t or not state[k]} and all(r.n_chars == len(r.text) for r in after.collect())
        elif name.startswith("n-gram"):
            sets = [(k, shingles(t)) for k, t in state.items()]
            links = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
            assert set(kept) == set(groups(state, links).values())
        else:
            assert set(kept) <= set(state) and all(kept[k] == state[k] for k in kept) and kept
        state, now = kept, after
    out = cp.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(state)
