from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import simhash as S


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=2):
    """rows of (id, fingerprint)"""
    codes = sorted({f for _, f in rows})
    group = {f: f for f in codes}
    changed = True
    while changed:
        changed = False
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= bits and group[b] < group[a]:
                    group[a], changed = group[b], True
    least = {}
    for i, f in rows:
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    return [(i, f, least.get(group[f])) for i, f in rows]


def test_query_against_brute_force(spark, sf, texts):
    got = S.op7_simhash(spark, sf).collect()
    want = brute_components([(k, brute_print(t)) for k, t in texts.items()])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", c) for i, f, c in want)


def test_edges(edges, nothing, edge_texts):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.simhash_components(edges).collect()]
    key = lambda r: (r[0] is None, str(r))
    assert sorted(got, key=key) == sorted(brute_components([(i, brute_print(t)) for i, t in edge_texts]), key=key)
    assert S.simhash_components(nothing).count() == 0
    kept = S.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.where("doc_id in (5, 6)").collect()) == [5]
    assert S.keep_one(nothing).count() == 0


def test_all_near_codes_of_a_dense_group(spark):
    """Codes around one centre: every link of up to two bits must hold the group together."""
    rng = np.random.default_rng(1)
    codes = set()
    for _ in range(400):
        code = 0x0123456789ABCDEF
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            code ^= 1 << int(b)
        codes.add(code)
    codes |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    signed = [(c - (1 << 64) if c >> 63 else c) for c in codes]
    links = S.near_fingerprints(spark.createDataFrame([(c, c) for c in signed], "id long, fp long")).collect()
    true = {i: c for i, _, c in brute_components([(c, c % (1 << 64)) for c in signed])}
    assert all(true[r.a] == true[r.b] for r in links)
    parent = {c: c for c in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = root(r.a), root(r.b)
        parent[max(a, b)] = min(a, b)
    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                assert root(a) == root(b)


def test_gray_neighbours_differ_in_one_bit(spark):
    for high in (0, 1 << 63):  # codes of both signs
        df = spark.range(64).select(F.col("id").bitwiseXOR(F.lit(high - (1 << 64) if high else 0)).alias("fp"))
        codes = np.array([r.fp for r in df.orderBy(S.gray_rank(F.col("fp"))).collect()])
        assert (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()
    ends = spark.createDataFrame([(0,), (-1,), (1 << 62,), (-(1 << 63),)], "fp long").orderBy(S.gray_rank(F.col("fp"))).collect()
    assert [r.fp % (1 << 64) for r in ends] == [0, 1 << 62, (1 << 64) - 1, 1 << 63]


def near_codes(n, seed):
    """Distinct codes: even ones, and chains of near ones."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 1 << 64, n, np.uint64)
    flips = [codes]
    for _ in range(3):
        step = flips[-1][: n // 8].copy()
        for _ in range(2):
            step ^= np.uint64(1) << rng.integers(0, 64, len(step)).astype(np.uint64)
        flips.append(step)
    return np.unique(np.concatenate(flips))


def all_pairs(a, b, bits=2):
    return {(int(i), int(j)) for at in range(0, len(a), 500) for i, j in zip(*np.nonzero(np.bitwise_count(a[at : at + 500, None] ^ b[None, :]) <= bits)) for i in [i + at]}


def in_gray_order(codes):
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return codes[np.argsort(rank)]


def test_tree_finds_all_pairs_and_prunes_above_the_leaves():
    a, b = (in_gray_order(near_codes(3000, k)) for k in (1, 2))
    b = in_gray_order(np.unique(np.concatenate((b, a[::7] ^ np.uint64(5)))))
    for bits in (0, 2, 3):
        for x, y in ((a, a), (a, b), (b, a[:5]), (a[:1], a[:1])):
            x, y = S.Tree(x), (S.Tree(y) if y is not x else None)
            y, pruned = x if y is None else y, [0] * 9
            got = [(int(i), int(j)) for p, q in S.near_pairs(x, y, bits, pruned) for i, j in zip(p, q)]
            want = all_pairs(x.codes, y.codes, bits)
            assert len(got) == len(set(got)) and set(got) == ({(i, j) for i, j in want if i < j} if x is y else want)
            if len(x.codes) > 100 and len(y.codes) > 100:
                assert sum(pruned[1:]) > 0  # whole groups of leaves go


def test_blocks_find_each_others_codes(spark):
    """More codes than a block holds: links go across blocks through the top of the index."""
    codes = near_codes(24_000, 3)
    whole, pruned = S.Tree(in_gray_order(codes)), [0] * 9
    near = sum(len(i) for i, _ in S.near_pairs(whole, whole, 2, pruned))
    assert sum(n > 0 for n in pruned[1:]) >= 2  # at more than one level above the leaves
    signed = codes.view(np.int64).tolist()
    links = S.near_fingerprints(spark.createDataFrame([(c,) for c in signed], "fp long")).collect()
    got = S._roots(len(codes), *(np.searchsorted(codes, np.array([r[k] for r in links], np.int64).view(np.uint64)) for k in (0, 1)))
    pairs = np.array(sorted(p for p in all_pairs(codes, codes) if p[0] < p[1]))
    assert (got == S._roots(len(codes), pairs[:, 0], pairs[:, 1])).all() and len(pairs) == near > 5000


def test_query_at_a_larger_scale(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = S.simhash_components(docs).collect()
    ids, codes = np.array([r.doc_id for r in rows]), np.array([r.fp for r in rows], np.int64).view(np.uint64)
    distinct, of = np.unique(codes, return_inverse=True)
    pairs = np.array(sorted(all_pairs(distinct, distinct)))
    root = S._roots(len(distinct), pairs[:, 0], pairs[:, 1])[of]
    least = {}
    for k, r in zip(ids.tolist(), root.tolist()):
        least[r] = min(k, least.get(r, k))
    assert [r.component_id for r in rows] == [least[r] for r in root.tolist()]


def test_keep_one_judges_an_id_text_by_text(spark):
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(30)) for w in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, a.upper()), (5, a), (5, b), (2, c), (2, c.upper()), (2, d), (2, d), (9, d)]
    kept = sorted((r.doc_id, r.text) for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(k, t.lower()) for k, t in kept] == [(1, a), (2, d), (2, c), (5, b)] and (1, a.upper()) in kept
