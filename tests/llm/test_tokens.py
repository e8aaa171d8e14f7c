from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from keyloom.llm import piece_sampling as G
from keyloom.llm import token_shards as T

# --- sampled segmentations


@pytest.fixture(scope="module")
def sampler():
    return G.Sampler(G.MODEL)


def all_ways(sampler, text):
    model = sentencepiece.SentencePieceProcessor(model_file=G.MODEL)
    t, out = G.SPACE + text.replace(" ", G.SPACE), {}

    def go(at, ids, weight):
        if at == len(t):
            out[tuple(ids)] = weight
            return
        for n in range(1, 17):
            if at + n > len(t):
                break
            k = model.piece_to_id(t[at : at + n])
            if np.isfinite(sampler.pieces.weight[k]):
                go(at + n, ids + [k], weight + float(sampler.pieces.weight[k]))
            elif n == 1:
                data = t[at].encode()
                go(at + 1, ids + [sampler.pieces.bytes_[b] for b in data], weight + len(data) * sampler.pieces.last)

    go(0, [], 0.0)
    top = np.logaddexp.reduce(list(out.values()))
    return {k: float(np.exp(w - top)) for k, w in out.items()}


def test_draws_follow_the_lattice_without_replacement(sampler):
    p = all_ways(sampler, "the cat\nç")
    n = 8000
    with np.errstate(over="ignore"):
        got = sampler.sample(["the cat\nç"] * n, G._mix(np.arange(n).astype(np.uint64)), 3)
    first, pair, weight = Counter(), Counter(), Counter()
    for ways in got:
        keys = [tuple(w[0].tolist()) for w in ways]
        assert len(set(keys)) == 3 and ways[0][2] >= ways[1][2] >= ways[2][2]
        for k, w in zip(keys, ways):
            assert abs(w[1] - np.log(p[k])) < 1e-3
            weight[k] += np.exp(-w[3])
        first[keys[0]] += 1
        pair[tuple(keys[:2])] += 1
    likely = sorted(p, key=p.get)[-3:]
    for a in likely:
        assert abs(first[a] / n - p[a]) < 0.025
        for b in likely:
            if a != b:
                assert abs(pair[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.025
    for a in likely[-2:]:  # samples weighted by inclusion are unbiased
        assert abs(weight[a] / n - 1) < 0.05


def test_rare_arcs_are_drawn_as_often_as_they_should_be(sampler):
    """Arcs far below single precision, and draws in the sliver that belongs to them."""
    lattices = G.Lattices(sampler.pieces, [G.SPACE + "ab"])
    row = int(lattices.base[0])
    width = lattices.log_p.shape[1]
    p = np.zeros(width)
    p[:3] = [1 - 3e-9, 1e-9, 2e-9]
    lattices.log_p[row] = np.log(np.maximum(p, 1e-300)).astype(np.float32)
    lattices.log_p[row, 3:] = -np.inf
    lattices.cumulative[row] = 1
    u = np.array([0.5, 1 - 4e-9, 1 - 2.5e-9, 1 - 1.5e-9, 1 - 2.0**-53])
    assert G._exact_arcs(lattices, np.full(5, row), u).tolist() == [0, 0, 1, 2, 2]
    # the draws of many seeds, pushed into the sliver, come from there
    n = 1_000_000
    with np.errstate(over="ignore"):
        seeds = G._mix(np.arange(n).astype(np.uint64))
    draws = G._uniform(seeds, np.uint64(0))
    p[:3] = [1 - 3e-6, 1e-6, 2e-6]
    lattices.log_p[row, :3] = np.log(p[:3])
    who, rows, arcs, _ = G._draw(lattices, np.zeros(n, np.int64), np.zeros(n, np.int64), seeds)
    first = arcs[np.searchsorted(who, np.arange(n))]
    assert (first == np.searchsorted(np.cumsum(p[:3]), draws, side="right")).mean() > 1 - 1e-6
    assert (first[draws >= 1 - 2.9e-6] > 0).all()


def test_all_ways_of_a_small_text(sampler):
    p = all_ways(sampler, "ab")
    got = sampler.sample(["ab"], np.array([5], np.uint64), 50)[0]
    assert {tuple(w[0].tolist()) for w in got} == set(p) and all(w[3] == 0 for w in got)


def test_edges(spark, edges, nothing, edge_texts):
    got = G.sample_segmentations(edges, samples=2)
    rows = got.collect()
    assert all(r.decoded for r in rows)
    assert {r.doc_id for r in rows} == {k for k, _ in edge_texts}
    assert [(r.n_pieces, r.log_inclusion) for r in rows if r.doc_id in (1, 2)] == [(0, 0.0)] * 2
    same = [r.ids for r in rows if r.doc_id == 5 and r.sample == 1]
    assert len(same) == 2 and same[0] == same[1]
    texts = {(r.doc_id, r.sample): r.text for r in G.decode_ids(got).collect() if r.doc_id is not None}
    assert all(texts[k, 1] == (t or "") for k, t in edge_texts if k is not None)
    assert G.sample_segmentations(nothing).count() == 0


def test_query_round_trip_and_partitions(spark, sf, docs):
    rows = {(r.doc_id, r.sample): r for r in G.op3_gumbel_top_k(spark, sf).collect()}
    assert all(r.decoded for r in rows.values()) and len(rows) > docs.count()
    assert all(r.log_prob <= 1e-3 and r.log_inclusion <= 0 for r in rows.values())
    again = G.sample_segmentations(docs.repartition(7), keep_ids=False).collect()
    assert {(r.doc_id, r.sample): r.ids_crc32 for r in again} == {k: r.ids_crc32 for k, r in rows.items()}


def test_query_returns_the_ids(spark, sf, texts):
    rows = G.op3_gumbel_top_k(spark, sf)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.n_pieces for r in rows.collect())
    assert {r.doc_id: r.text for r in G.decode_ids(rows.where("sample = 1")).collect()} == texts


# --- training order


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 65_537])
def test_permutation(n):
    with np.errstate(over="ignore"):
        a, b = T.permuted(np.arange(n), n), T.permuted(np.arange(n), n, key=1)
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 100 or (a != b).any() and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.15


def restored(ordered, spark, path, length=T.LENGTH):
    T.write_shards(ordered, path)
    stride = 4 + 2 * length
    read = {r.slot: r.ids for r in T.read_from(spark, path, 0, stride=stride).collect()}
    docs = {}
    for r in ordered.select("doc_id", "part", "slot", "n_tokens").collect():
        assert len(read[r.slot]) == r.n_tokens
        docs.setdefault(r.doc_id, []).append((r.part, read[r.slot]))
    assert sorted(read) == list(range(len(read)))
    return {k: [x for _, ids in sorted(v) for x in ids] for k, v in docs.items()}, read


def test_shards_round_trip(spark, docs, texts, tmp_path):
    ordered = T.written(T.training_order(docs), "o")
    path = f"file://{tmp_path}/shards"
    got, read = restored(ordered, spark, path)
    encoding = T._encoding(T.RANKS)
    assert {k: encoding.decode(ids[:-1]) for k, ids in got.items()} == texts
    assert all(ids[-1] == T.END_ID for ids in got.values())
    resumed = {r.slot: r.ids for r in T.read_from(spark, path, 100).collect()}
    assert resumed == {k: v for k, v in read.items() if k >= 100}


def test_order_edges(spark, edges, nothing, edge_texts):
    ordered = T.written(T.training_order(edges), "o")
    slots = sorted(r.slot for r in ordered.collect())
    assert slots == list(range(len(slots)))
    ends = [r for r in ordered.where("doc_id in (1, 2)").collect()]
    assert [(r.part, r.n_tokens, len(r.record)) for r in ends] == [(0, 1, T.STRIDE)] * 2
    assert ordered.where("part = 0").count() == len(edge_texts)
    assert T.training_order(nothing).count() == 0


def test_one_key_gives_one_order_however_the_table_is_split(spark, edges, edge_texts):
    rows = [(None if k % 7 == 0 else k % 90, f"text number {k % 100} " * (k % 40)) for k in range(300)] + [(5, "again and again")] * 200 + [(k, t) for k, t in edge_texts if t and len(t) < 60_000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    orders = []
    for parts in (1, 5, 64):
        got = T.training_order(df.orderBy(F.rand(parts)).repartition(parts)).collect()
        orders.append(sorted((r.slot, r.doc_id, r.part, r.n_tokens, bytes(r.record)) for r in got))
        assert [o[0] for o in orders[-1]] == list(range(len(got)))
    assert orders[0] == orders[1] == orders[2] and len(orders[0]) > len(rows)


def test_slots_and_records_against_brute_force(spark, sf, texts):
    """Ids and places made one by one: documents by id, their sequences in turn, then the permutation."""
    encoding = T._encoding(T.RANKS)
    want, at = {}, 0
    n = sum(-(-(len(encoding.encode_ordinary(t)) + 1) // T.LENGTH) for t in texts.values())
    with np.errstate(over="ignore"):
        slots = T.permuted(np.arange(n), n)
    for k in sorted(texts):
        ids = [*encoding.encode_ordinary(texts[k]), T.END_ID]
        for part, start in enumerate(range(0, len(ids), T.LENGTH)):
            own = ids[start : start + T.LENGTH]
            record = len(own).to_bytes(4, "little") + b"".join(x.to_bytes(2, "little") for x in own + [T.END_ID] * (T.LENGTH - len(own)))
            want[k, part] = (len(own), int(slots[at]), zlib.crc32(record))
            at += 1
    got = {(r.doc_id, r.part): (r.n_tokens, r.slot, r.record_crc32) for r in T.op4_feistel_order(spark, sf).collect()}
    assert got == want


def test_order_query(spark, sf, texts):
    rows = T.op4_feistel_order(spark, sf).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.doc_id for r in rows} == set(texts)
    assert all((r.shard, r.byte_offset) == (r.slot // T.PER_SHARD, r.slot % T.PER_SHARD * T.STRIDE) for r in rows)


def test_order_query_stores_what_it_digests(spark, sf, texts):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("shards-*"))
    rows = {r.slot: r for r in T.op4_feistel_order(spark, sf).collect()}
    (path,) = set(shared.glob("shards-*")) - before
    docs = {}
    for r in T.read_from(spark, f"file://{path}", 0).collect():
        own = rows.pop(r.slot)
        record = r.n_tokens.to_bytes(4, "little") + np.pad(np.array(r.ids, "<u2"), (0, T.LENGTH - len(r.ids)), constant_values=T.END_ID).tobytes()
        assert (own.n_tokens, own.record_crc32) == (r.n_tokens, zlib.crc32(record))
        docs.setdefault(own.doc_id, {})[own.part] = r.ids
    encoding = T._encoding(T.RANKS)
    assert not rows
    assert {k: encoding.decode([x for p in sorted(v) for x in v[p]][:-1]) for k, v in docs.items()} == texts


def test_shards_of_null_ids_and_of_nothing(spark, edges, nothing, edge_texts, tmp_path):
    for name, docs, n in (("edges", edges, len(edge_texts)), ("nothing", nothing, 0)):
        path = f"file://{tmp_path}/{name}"
        T.write_shards(T.training_order(docs), path)
        kept = [(k, p) for r in T.stored(spark, path).collect() for k, p in zip(r.doc_ids, r.parts)]
        assert sum(p == 0 for _, p in kept) == n == sum(r.ids[-1] == T.END_ID for r in T.read_from(spark, path, 0).collect())
        assert sum(k is None for k, _ in kept) == (2 if n else 0)


def test_draws_are_made_for_all_texts_at_once(monkeypatch):
    from keyloom.llm import piece_sampling

    sampler = piece_sampling._sampler(piece_sampling.MODEL)
    places, ids = sampler.pieces.find(sampler.pieces.hashes)
    assert places.tolist() == list(range(len(sampler.pieces.ids))) and (ids == sampler.pieces.ids).all()
    made, uniform = [], piece_sampling._uniform
    monkeypatch.setattr(piece_sampling, "_uniform", lambda *parts: made.append(1) or uniform(*parts))
    calls = []
    for n in (5, 100):
        made.clear()
        ways = sampler.sample(["some words and a few more"] * n, np.arange(n, dtype=np.uint64) + np.uint64(9), 2)
        assert all(len(w) == 2 for w in ways)
        calls.append(len(made))
    assert calls[1] < calls[0] + 50
