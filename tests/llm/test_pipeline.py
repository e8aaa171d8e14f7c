from __future__ import annotations

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from keyloom.llm import language_id, packing, pii, quality, simhash
from keyloom.llm.common import documents, written
from tests.llm.test_packing import check, token_ids
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    kept = []
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    start = {r.doc_id: r for r in documents(spark, SF).collect()}
    language, good, once, masked = kept
    assert all(any(c.isalpha() for c in r.text) for r in language.values()) and len(language) > 0.95 * len(start)
    for k, r in good.items():
        n, _, _, _, repeated = brute_quality(r.text)
        assert k in language and n >= 20 and 100 * repeated <= 30 * n
    groups = brute_components([(k, brute_print(r.text)) for k, r in good.items()])
    assert set(once) == {k for k, _, c in groups if k == c}
    assert set(masked) == set(once)
    for k, r in masked.items():
        assert brute_pii(r.text) == "" and (r.text == once[k].text) == (brute_pii(once[k].text) == "") and r.n_chars == len(r.text)
    rows = C.STAGES[-1][1](spark, docs, SF).collect()
    check(rows, token_ids((k, r.text) for k, r in masked.items()), packing.CAPACITY)
    assert sorted(map(str, rows)) == sorted(map(str, C.run(spark, SF).collect()))


def test_stages_keep_good_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    docs = documents(spark, SF).join(labels, "doc_id", "left_semi")
    long_enough = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 20 and 100 * brute_quality(r.text)[4] <= 30 * len(r.text.split())}
    after = C.filter_quality(spark, C.identify_language(spark, documents(spark, SF), SF), SF)
    assert len(long_enough - {r.doc_id for r in after.collect()}) <= 1


def test_edges_go_through(spark, edges, edge_texts, nothing):
    """All five stages: what is kept, and that columns and clashing names come through."""
    found = {}
    for table, into in ((edges, found), (nothing, {})):
        docs = table
        for name, stage in C.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), name)
            assert docs.columns == table.columns
            into[name] = docs.collect()
        into["packed"] = C.STAGES[-1][1](spark, docs, SF).collect()
        assert table is edges or not any(into.values())
    key = lambda p: str(p)
    pairs = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=key)
    # nothing is labelled with a language: only texts without a letter go
    assert pairs(found["language_id"]) == sorted(((k, t) for k, t in edge_texts if t and any(c.isalpha() for c in t)), key=key)
    assert all(r.record == r.spans == r["a b"] == "x" for r in found["language_id"])
    kept = [(k, t) for k, t in pairs(found["language_id"]) if len(t.split()) >= 20]
    assert set(pairs(found["quality_rules"])) <= set(kept)
    # the stages after, on all of the edge table
    once = C.drop_near_duplicates(spark, edges, SF).collect()
    assert [r.doc_id for r in once if r.text and r.text.startswith("The same")] == [5]
    assert sum(r.doc_id is None for r in once) == 2 and {r.doc_id for r in once if r.doc_id} <= {k for k, _ in edge_texts}
    masked = {r.doc_id: r for r in C.mask_personal_data(spark, edges, SF).collect() if r.doc_id}
    assert masked[9].text == "[EMAIL] +1 (212) 555-0100 [IP] 4111 1111 1111 1111" and masked[9].n_chars == len(masked[9].text) and masked[1].text is None
    assert masked[7].text == dict(edge_texts)[7] and masked[2].text == ""
    packed = C.pack_sequences(spark, edges, SF).collect()
    assert {r.doc_id for r in packed} == {k for k, _ in edge_texts} and sum(r.piece == 0 for r in packed) == len(edge_texts)


def test_operators_are_those_of_the_list():
    assert [n for n, _ in C.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "pii", "best_fit_packing"]
    assert all(m.__name__.startswith("keyloom.llm") for m in (language_id, quality, simhash, pii, packing))


def test_packing_returns_the_ids(spark):
    docs = documents(spark, SF)
    rows = C.pack_sequences(spark, docs, SF).collect()
    want = token_ids((r.doc_id, r.text) for r in docs.collect())
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {k: [x for ids in v for x in ids.tolist()] for k, v in want.items()}


def test_texts_go_to_python_once_and_come_back_in_small_batches(spark):
    docs = spark.createDataFrame([(k, f"some words {k}" if k % 7 else None) for k in range(3000)], "doc_id long, text string")
    network = language_id.Network(["de", "en"], seed=2)
    model = quality.Model(np.zeros(quality.WORD_BUCKETS + quality.CHAR_BUCKETS), 0.0, 1.0, 1.0)
    for found in (language_id.identify(docs, network), quality.judge_quality(docs, model)):
        sent = found._jdf.queryExecution().analyzed().children().apply(0).schema().simpleString()
        assert sent.count("text:string") + sent.count("binary") == 1
        assert sorted((r.record.doc_id, r.record.text) for r in found.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    texts = [f"some words {k}" if k % 7 else None for k in range(3000)]
    record = pa.StructArray.from_arrays([pa.array(range(3000)), pa.array(texts)], ["doc_id", "text"])
    whole = pa.RecordBatch.from_arrays([record, pa.array([t is not None for t in texts])], ["record", "letters"])
    parts = list(language_id._label(network)(iter([whole])))
    assert pa.Table.from_batches(parts).column("record").to_pylist() == record.to_pylist()
    assert max(map(len, parts)) < 1000
    one = network.pool([(t or "").encode() for t in texts]).max(axis=1)
    got = pa.Table.from_batches(parts).column("score").to_numpy()
    assert all(abs(a - b) < 1e-5 if t else a == 0 for a, b, t in zip(got, one, texts))


def test_stages_send_python_few_bytes_at_once(spark):
    """A batch is held by the executor's JVM and by Python, for each core, so 10,000 texts are too many."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 200) as text", "'en' as lang", "2200L as n_chars")
    few = texts.limit(20)
    try:
        for name, stage in C.STAGES:
            if name in ("quality_rules", "pii"):  # the one needs labels, the other no Python
                continue
            spark.conf.unset(limit)
            stage(spark, few, "").schema
            sent = [r["size"] for r in texts.mapInArrow(sizes, "size long").collect()]
            assert sum(sent) > 6_000_000 and max(sent) < 1_500_000, name
        spark.conf.set(limit, "65536")
        C.drop_near_duplicates(spark, few, "")
        assert spark.conf.get(limit).removesuffix("b") == "65536"
    finally:
        spark.conf.unset(limit)
