from __future__ import annotations

import re
from collections import Counter

import numpy as np

from keyloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = [False] * len(words)
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            marked[k : k + 8] = [True] * 8
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, sum(marked)


def test_query_against_brute_force_and_labels(spark, sf, texts):
    got = quality.op1_ngram_logistic(spark, sf).toPandas()
    assert len(got) == len(texts)
    for r in got.itertuples():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got[~got.base_failed].merge(labels, on="doc_id")
    assert (both.kept == (both.quality > 0)).mean() > 0.97


def test_held_out_accuracy(spark):
    """Fitted to the labels of one size, judged on the labels of another."""
    near, far = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
    model = quality.train(spark.read.parquet(f"{far}/documents.parquet"), spark.read.parquet(f"{far}/labels.parquet").where("doc_id % 3 <> 0"))
    judged = quality.judge_quality(spark.read.parquet(f"{far}/documents.parquet").where("doc_id % 3 = 0"), model, carry=["doc_id"]).selectExpr("record.doc_id", "base_failed", "kept").toPandas()
    both = judged[~judged.base_failed].merge(spark.read.parquet(f"{far}/labels.parquet").toPandas(), on="doc_id")
    assert len(both) > 50 and (both.kept == (both.quality > 0)).mean() > 0.95
    assert near


def test_edges(edges, nothing, edge_texts):
    model = quality.fit(np.zeros((0, 8192), np.float32), np.zeros(0, bool), np.zeros(0, bool))
    got = quality.judge_quality(edges, model)
    assert got.columns[0] == "record" and got.select("record.*").columns == edges.columns
    stats = sorted(tuple(r) for r in got.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert stats == sorted(brute(t) for _, t in edge_texts)
    assert quality.judge_quality(nothing, model).count() == 0


def test_no_labels_and_one_class(spark, docs, sf):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none).probability(np.zeros((1, 8192), np.float32))[0] > 0.9
    one = spark.createDataFrame([(k, 0) for k in range(50)], "doc_id long, quality int")
    assert quality.train(docs, one).probability(np.zeros((1, 8192), np.float32))[0] < 0.2


def test_repeated_windows():
    words = b"a b c d e f g h".split()
    assert quality.repeated_words(words * 2) == 16
    assert quality.repeated_words(words + [b"x"] + words) == 16
    assert quality.repeated_words(words[:7] * 2) == 0
    assert quality.repeated_words(words) == 0
