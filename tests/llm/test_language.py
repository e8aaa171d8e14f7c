from __future__ import annotations

import zlib

import numpy as np

from keyloom.llm import language_id as L


def test_gradients_against_differences():
    net = L.Network(["a", "b", "c"], hidden=3, seed=1)
    x = np.array([[1, 2], [3, 4], [5, L.PAD], [7, L.PAD]])
    y = np.array([0, 2])
    grad = net.step(x, y)

    def loss():
        p = net.positions(x).astype(float)
        real = x != L.PAD
        return -sum(np.log(p[t, b, y[b]]) for t in range(4) for b in range(2) if real[t, b]) / real.sum()

    rng = np.random.default_rng(0)
    for key, g in grad.items():
        owner = getattr(net, key[0]) if key[0] else net
        table = getattr(owner, key[1])
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in table.shape)
            if key[1] == "embed" and at[0] == L.PAD:
                continue
            was = table[at]
            table[at] = was + 1e-2
            up = loss()
            table[at] = was - 1e-2
            down = loss()
            table[at] = was
            assert abs((up - down) / 2e-2 - g[at]) < 2e-4


def test_padding_changes_nothing():
    net = L.Network(["a", "b"], seed=3)
    alone = net.pool([b"hello world"])
    together = net.pool([b"hello world", b"x" * 1000, b"", "é".encode() * 70])
    assert np.allclose(alone[0], together[0], atol=1e-6) and np.allclose(together.sum(axis=1)[[0, 1, 3]], 1, atol=1e-5)


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op5_bidirectional_gru(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert (both.held_out == both.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 4 == 2)).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert both.score.between(0, 1).all()


def test_training_never_sees_held_out(spark, docs):
    marked = docs.withColumn("lang", L.F.when(L.held_out(L.F.col("doc_id")), "secret").otherwise(L.F.col("lang")))
    languages, _, _ = L.training_pieces(marked)
    assert "secret" not in languages and languages


def test_edges(spark, edges, nothing, docs):
    net = L.train(docs)
    got = L.identify(edges, net)
    assert got.select("record.*").columns == edges.columns
    by = {(r.record.doc_id, r.record.text): (r.lang_pred, r.score) for r in got.collect()}
    assert by[(1, None)] == by[(2, "")] == by[(3, " \t\n")] == by[(10, "1234 !!!! ????")] == ("und", 0.0)
    assert by[(4, "one")][0] in net.languages
    assert got.count() == edges.count()
    assert L.identify(nothing, net).count() == 0
    assert L.train(nothing) is None
    assert {r.lang_pred for r in L.identify(edges, None).collect()} == {"und"}


def test_long_text_is_read_whole(spark, docs):
    net = L.train(docs)
    en, de = (docs.where(f"lang = '{x}' and n_chars > 500").first().text for x in ("en", "de"))
    text = en[:400] + " " + de * 40
    got = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    assert got.lang_pred == "de"


def test_every_language_is_learned(spark):
    rows = [(20 * k + j, f"{chr(0x4E00 + k)} {j}", f"l{k:02}") for k in range(70) for j in range(20)]
    languages, pieces, labels = L.training_pieces(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == [f"l{k:02}" for k in range(70)] and set(labels) == set(range(70))


def test_reject_limit_follows_chance():
    limits = [L.reject_below(L.Network([str(k) for k in range(n)])) for n in (1, 2, 4, 100)]
    assert limits == [0.0, 0.6, 0.3, 0.012] and L.reject_below(None) == 0.0
