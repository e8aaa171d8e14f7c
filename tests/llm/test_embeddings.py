from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from keyloom.llm import embedding_dedup as E
from keyloom.llm.graph import connected_components


def brute(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = {k: set() for k in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i].add(j)
                    links[j].add(i)
    comp = list(range(len(rows)))
    for _ in rows:
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    for _ in rows:
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    least_id = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in set(comp)}
    return sorted((rows[i][0], len(links[i]), least_id[comp[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [8, 1024])
def test_against_brute_force(spark, monkeypatch, tile):
    """Groups of near copies, exact copies, and a bucket that is larger than a tile."""
    rng = np.random.default_rng(tile)
    rows, k = [], 0
    for size in (1, 1, 2, 5, 40):
        centre = rng.standard_normal(16)
        for _ in range(size):
            rows.append((k, [float(x) for x in centre + 0.05 * rng.standard_normal(16)]))
            k += 1
    rows += [(k + j, rows[3][1]) for j in range(6)]
    k += 6
    rows += [(k, None), (k + 1, []), (k + 2, [0.0] * 16), (k + 3, [math.nan] * 16), (k + 4, [math.inf] + [1.0] * 15), (k + 5, [None] + [1.0] * 15), (k + 6, [1e300] * 16), (k + 7, [1e-300] * 16), (k + 8, [1.0] * 3)]
    monkeypatch.setattr(E.near_vectors, "__defaults__", (0.95, E.SEED, tile))
    got = E.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_query(spark, sf):
    got = E.op2_sign_hashing(spark, sf)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == brute(rows)


def test_recall_is_kept_as_rows_grow():
    for rows in (10, 10_000, 10_000_000_000):
        tables, bits = E.tables_for(rows)
        met = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - met) ** tables >= 1 - E.MISSED


def test_recall_on_planted_pairs(spark):
    """3,000 pairs just above the limit among 26,000 vectors; links exact for what is found, none below."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((23_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((3000, 64))
    side -= (side * base[:3000]).sum(axis=1, keepdims=True) * base[:3000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.97, (3000, 1))
    vectors = np.concatenate((base, cosine * base[:3000] + np.sqrt(1 - cosine**2) * side)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in E.embedding_components(df).collect()}
    assert len(got) == len(vectors)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    true = [set(np.flatnonzero(row >= 0.95).tolist()) for at in range(0, len(unit), 2000) for row in unit[at : at + 2000] @ unit.T]
    pairs = {(a, b) for a, t in enumerate(true) for b in t if a < b}
    assert len(pairs) >= 3000
    found = sum(got[a].component_id == got[b].component_id and got[a].n_links > 0 for a, b in pairs)
    assert found >= 0.99 * len(pairs)
    # each vector here has one partner at most, so links are its pair or nothing
    assert all(r.n_links <= len(true[k] - {k}) for k, r in got.items()) and sum(r.n_links for r in got.values()) == 2 * found
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_oracle(spark, sf):
    con = duckdb.connect()
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(8)
    rows = [(k, (centre + 0.2 * rng.standard_normal(8)).tolist()) for k in range(40)] + [(50, [0.0] * 8), (51, None), (52, [1.0] * 3), (53, [None] * 8), (54, rows_ := [1.0] * 8), (55, rows_)]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841
    con.execute("create table embeddings as select vec_id, embedding::float[] as embedding from frame")
    want = con.execute(E.OP2_SQL).fetchall()
    df = spark.createDataFrame(con.execute("select * from embeddings").fetchall(), "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_components(df).collect()]
    assert sorted(got) == sorted(want) and any(r[1] > 1 for r in want)


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, class int, vector string, links int"
    assert E.embedding_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1, "a", 1), (1, [1.0, 0.0], 1, "a", 1), (None, [1.0, 0.0], 1, "a", 1), (2, [0.0, 1.0], 1, "a", 1)]
    got = E.embedding_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("shape", ["chain", "star", "none", "two"])
def test_components(spark, shape):
    edges = {"chain": [(k, k + 1) for k in range(40)], "star": [(99, k) for k in range(40)], "none": [], "two": [(5, 6), (6, 5), (7, 7), (8, 5), (20, 30), (None, 3)]}[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {"chain": {k: 0 for k in range(41)}, "star": {**{k: 0 for k in range(40)}, 99: 0}, "none": {}, "two": {5: 5, 6: 5, 8: 5, 20: 20, 30: 20}}[shape]
    assert got == want
