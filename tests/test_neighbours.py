"""Nearest vectors against brute force: cells, ties, odd vectors, bands."""

import numpy as np
import pytest

from tracelake.operators import neighbours as nb
from tracelake.operators import vectors as vx
from tracelake.plans.search_queries import novelty_lsh


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def clustered(n=600, d=8, seed=4):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, d))
    return [(i, centres[i % 12] + 0.2 * draw.standard_normal(d)) for i in range(n)]


def brute(queries, vectors, k, floor):
    unit = lambda rows: np.array([v / np.linalg.norm(v) for _, v in rows])
    s = np.round(unit(queries) @ unit(vectors).T, 6)
    out = []
    for row, (q, _) in zip(s, queries, strict=True):
        found = sorted((-x, i) for x, (i, _) in zip(row, vectors, strict=True) if i != q and x >= floor)
        out += [(q, i, rank + 1) for rank, (_, i) in enumerate(found[:k])]
    return sorted(out)


def ours(found):
    return sorted((r["query_id"], r["vec_id"], r["rank"]) for r in found.collect())


@pytest.mark.parametrize("cell_rows", [20, 200, 10_000])
def test_cells_equal_brute_force(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK_ROWS", 25)
    monkeypatch.setattr(nb, "QUERY_ROWS", 40)
    rows = clustered()
    asked = rows[::7]
    found = nb.knn(frame(spark, asked).withColumnRenamed("vec_id", "query_id"), frame(spark, rows), 5, 0.3, cell_rows=cell_rows)
    assert ours(found) == brute(asked, rows, 5, 0.3)


def test_cells_are_passed_over(spark):
    """With tight clusters a query looks into few of the cells."""
    rows = clustered()
    cells = nb.Cells([list(v) for _, v in rows[:12]])
    unit = np.array([v / np.linalg.norm(v) for _, v in rows])
    numbers, angle = cells.angles(unit)
    own = angle.argmin(axis=1)
    for c in range(12):
        mine = angle[own == c, c]
        cells.count[c], cells.near[c], cells.far[c] = len(mine), mine.min(initial=9), mine.max(initial=-1)
    assert (cells.best_score(numbers, angle) >= 0.9).mean() < 0.5
    for c in range(12):  # the bound is one
        best = (unit @ unit[own == c].T).max(axis=1)
        assert (cells.best_score(numbers, angle)[:, c] >= best - 1e-9).all()


def test_odd_vectors(spark):
    rows = [(1, [1, 0]), (2, [2, 0]), (3, [0, 0]), (4, None), (5, [1]), (6, [3]), (7, []), (8, [float("nan"), 1]), (9, [float("inf"), 1]), (10, [1, 1]), (None, [1, 0])]
    vectors = frame(spark, rows).union(spark.sql("select 11L, array(cast(null as double), 1.0d)"))
    found = nb.knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 3, 0.3, cell_rows=2)
    assert ours(found) == [(1, 2, 1), (1, 10, 2), (2, 1, 1), (2, 10, 2), (5, 6, 1), (6, 5, 1), (10, 1, 1), (10, 2, 2)]
    assert nb.knn(vectors.limit(0).withColumnRenamed("vec_id", "query_id"), vectors, 3).count() == 0
    assert nb.knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors.limit(0), None).count() == 0
    for mode in ("existing", "greedy", "lsh"):
        verdicts = {r["vec_id"]: r["verdict"] for r in vx.novelty_gate(vectors.where("vec_id > 1"), vectors.where("vec_id = 1"), mode=mode).collect()}
        assert verdicts[2] == "duplicate" and verdicts[3] == verdicts[4] == verdicts[7] == "novel"


def test_bands_find_the_repeats(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK_ROWS", 50)
    draw = np.random.default_rng(8)
    old = [(i, draw.standard_normal(64)) for i in range(300)] + [(i, np.ones(64)) for i in range(300, 500)]
    new = [(1000 + i, old[i][1] + 0.4 * draw.standard_normal(64)) for i in range(500)]
    exact = {r["vec_id"]: r for r in vx.novelty_gate(frame(spark, new), frame(spark, old)).collect()}
    found = {r["vec_id"]: r for r in vx.novelty_gate(frame(spark, new), frame(spark, old), mode="lsh").collect()}
    repeats = [i for i, r in exact.items() if r["verdict"] == "duplicate"]
    assert len(repeats) > 300 and set(found) == set(exact)
    assert sum(found[i]["verdict"] == "duplicate" for i in repeats) >= 0.95 * len(repeats)
    assert all(r["best"] is None or r["best"] <= exact[i]["best"] for i, r in found.items())


def test_bands_on_the_given_vectors(spark, sf_dir):
    exact = {r["vec_id"]: r["verdict"] for r in vx.novelty_gate(*(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(c) for c in ("vec_id % 3 <> 0", "vec_id % 3 = 0")), 0.35, 0.25).collect()}
    found = {r["vec_id"]: r["verdict"] for r in novelty_lsh(spark, sf_dir).collect()}
    repeats = [i for i, v in exact.items() if v == "duplicate"]
    assert set(found) == set(exact) and repeats
    assert sum(found[i] == "duplicate" for i in repeats) >= 0.95 * len(repeats)
    assert all(exact[i] == "duplicate" for i, v in found.items() if v == "duplicate")


def test_nothing_to_compare_with(spark):
    """Against no vectors, or none with a direction, every query is without a neighbour."""
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    none, flat = some.limit(0), spark.createDataFrame([(3, [0.0, 0.0]), (4, None)], some.schema)
    for known in (none, flat):
        assert nb.knn(some.selectExpr("vec_id AS query_id", "embedding"), known, k=1).count() == 0
        assert {r["verdict"] for r in vx.novelty_gate(some, known, mode="greedy").collect()} == {"novel"}


def test_few_scores_are_put_in_order(monkeypatch):
    import numpy as np

    from tracelake.operators import neighbours as ne

    draw = np.random.default_rng(5)
    s, vec = np.round(draw.uniform(-1, 1, (400, 300)), 3) + draw.uniform(-6e-7, 6e-7, (400, 300)), draw.permutation(400)
    s[draw.uniform(size=s.shape) < 0.3] = -np.inf
    s[:, 7] = -np.inf
    seen, plain = [], ne.rounded
    monkeypatch.setattr(ne, "rounded", lambda x, *a: (seen.append(x.size), plain(x, *a))[1])
    for k in (1, 3, 399):
        kept = ne.best_of_batch(s, vec, k)
        for j in range(s.shape[1]):
            own = sorted(((-r, v, i) for i, (r, v) in enumerate(zip(plain(s[:, j]).tolist(), vec.tolist())) if s[i, j] > -np.inf))[:k]
            assert sorted(np.flatnonzero(kept[:, j]).tolist()) == sorted(i for _, _, i in own)
    assert seen[0] < 0.05 * s.size  # all of them before


def test_greedy_gate_in_rounds_keeps_no_pairs(spark, monkeypatch):
    """Clusters, copies, odd vectors, two lengths and a repeated id, decided thirty at a time: as one after another, and no list of pairs."""
    asked = []
    monkeypatch.setattr(vx, "HEAD_ROWS", 30, raising=False)
    monkeypatch.setattr(vx, "knn", lambda *a, **how: asked.append(how.get("k", 500)) or nb.knn(*a, **how))
    stored = [(1000 + i, v) for i, v in clustered(5, seed=9)]
    rows = [*clustered(150), *((200 + i, [1.0] * 8) for i in range(70)), (300, [1.0, 2.0]), (301, [1.0, 2.01]), (302, None), (303, [0.0] * 8), (7, [1.0, 2.0])]
    got = {(r["vec_id"], r["verdict"]) for r in vx.novelty_gate(frame(spark, rows), frame(spark, stored), 0.9, 0.5, "greedy").collect()}
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    score = lambda v, others: max((round(float(unit(v) @ u), 6) for u in others if len(u) == len(v)), default=-1.0)
    old, taken, want = [unit(v) for _, v in stored], [], set()
    for i in sorted({i for i, _ in rows}):
        own = [v for j, v in rows if j == i and v is not None and any(v)]
        if any(score(v, old + taken) > 0.9 for v in own):
            want.add((i, "duplicate"))
        else:
            taken += [unit(v) for v in own]
            want.add((i, "refinement" if any(score(v, old) >= 0.5 for v in own) else "novel"))
    assert got == want and {x[1] for x in want} == {"duplicate", "refinement", "novel"}
    assert None not in asked
