"""Quality rules: text statistics, then calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import documents, record_schema, recorded, texts_of, thin_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
WORD_BUCKETS = 4096
CHAR_BUCKETS = 4096
CHAR_GRAM = 4
SEGMENT = 1 << 20
#: Labelled documents that a model is fitted to, at most about this many.
TRAIN_ROWS = 2000
CALIBRATION = 4  # one labelled document in so many is held back to calibrate
KEEP_AT = 0.3  # a document goes if its probability of good quality is lower
SEED = 5


def text_statistics(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text's UTF-8 bytes."""
    words = data.split()
    spaces = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
    inner = len(data.translate(None, CONTINUATION)) - spaces
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = data.split(b"\n")
    dup = 0
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip())
            seen.add(line)
    return len(words), inner, symbols, dup, repeated_words(words)


CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rows = np.zeros(n, np.uint64)
    for k in range(window):
        rows = rows * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        rows ^= rows >> np.uint64(29)
    order = np.argsort(rows, kind="stable")
    same = rows[order][1:] == rows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def gram_counts(data: bytes) -> np.ndarray:
    """Root frequencies of hashed words, word pairs and character n-grams, whole text."""
    words = data.split()
    out = np.zeros(WORD_BUCKETS + CHAR_BUCKETS, np.float32)
    if words:
        one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        two = one[1:] * np.uint32(2654435761) ^ one[:-1]
        counts = np.bincount(np.concatenate((one, two)) % WORD_BUCKETS, minlength=WORD_BUCKETS)
        out[:WORD_BUCKETS] = np.sqrt(counts / counts.sum())
        counts = np.zeros(CHAR_BUCKETS, np.int64)
        for at in range(0, len(data), SEGMENT):
            b = np.frombuffer(data[at : at + SEGMENT + CHAR_GRAM - 1], np.uint8).astype(np.uint32)
            m = len(b) - CHAR_GRAM + 1
            if m > 0:
                h = np.zeros(m, np.uint32)
                for k in range(CHAR_GRAM):
                    h = h * np.uint32(16777619) ^ b[k : k + m]
                h ^= h >> np.uint32(15)
                counts += np.bincount(h % CHAR_BUCKETS, minlength=CHAR_BUCKETS)
        if counts.any():
            out[WORD_BUCKETS:] = np.sqrt(counts / counts.sum())
    return out


class Model:
    """Weights of the n-grams, and slope and offset that make the score a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def probability(self, grams: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * (grams @ self.weights + self.bias) + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(x: np.ndarray, y: np.ndarray, decay: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch descent with momentum, classes weighted evenly."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(steps):
        error = (_sigmoid(x @ w + b) - y) * share
        vw = np.float32(0.9) * vw - np.float32(rate) * (error @ x + np.float32(decay) * w)
        vb = 0.9 * vb - rate * float(error.sum())
        w, b = w + vw, np.float32(b + vb)
    return w, float(b)


def fit(grams: np.ndarray, good: np.ndarray, held: np.ndarray) -> Model:
    """Fit on the rows not held, calibrate (Platt) on the held ones.

    Platt's targets keep a small held set from giving probabilities of 0 or 1.  With
    rows of one class only, the model gives that class's share.
    """
    y = good.astype(float)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 1.0
        return Model(np.zeros(WORD_BUCKETS + CHAR_BUCKETS), 0.0, 1.0, float(np.log(p / max(1e-9, 1 - p))) if p < 1 else 40.0)
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held = np.zeros(len(y), bool)
    w, b = _descend(grams[~held], y[~held], 1e-4, 300, 3.0)
    rest = held if held.any() else ~held
    s, t = grams[rest] @ w + b, y[rest]
    target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    spread = s.std() + 1e-9
    slope, offset = _descend((s / spread)[:, None], target, 1e-6, 400, 0.5)
    return Model(w, b, float(slope[0] / spread), float(offset))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [gram_counts(x.as_buffer().to_pybytes()).astype(np.float16).tobytes() for x in batch.column("data")]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("held"), pa.array(rows, pa.binary())], ["quality", "held", "grams"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED) -> Model:
    """Fit to a bounded sample of the labelled documents.

    A seeded hash of doc_id picks about `rows` of them; only their hashed n-gram
    frequencies, of fixed size, come to the driver.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"])
    total = known.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < min(1.0, rows / max(1, total)))
    held = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(CALIBRATION)) == 0
    # the sample has about `rows` rows of two numbers, whatever the corpus
    text = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("data"))
    labelled = text.join(F.broadcast(sample), "doc_id").select("quality", held.alias("held"), "data")
    got = labelled.mapInArrow(_gram_rows, "quality int, held boolean, grams binary").toArrow()
    width = WORD_BUCKETS + CHAR_BUCKETS
    grams = np.frombuffer(b"".join(got.column("grams").to_pylist()), np.float16).reshape(-1, width).astype(np.float32)
    return fit(grams, np.array(got.column("quality").to_pylist(), int) > 0, np.array(got.column("held").to_pylist(), bool))


def _score(model: Model, keep_at: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in thin_batches(batches):
            stats, probability = [], []
            for x in texts_of(batch):
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                stats.append(text_statistics(data))
                probability.append(float(model.probability(gram_counts(data))))
            n = np.array(stats, np.int64).reshape(-1, 5)
            failed = (n[:, 0] < MIN_WORDS) | (100 * n[:, 4] > MAX_REPEATED * n[:, 0])
            p = np.array(probability, float)
            own = [*(pa.array(n[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p)]
            yield pa.RecordBatch.from_arrays([batch.column("record"), *own], ["record", *names, "base_failed", "kept", "probability"])

    return score


def judge_quality(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, carry: list[str] | None = None) -> DataFrame:
    """docs' rows as (record struct, statistics, base_failed, kept, probability).

    kept is false if base_failed, else whether the calibrated probability of good
    quality reaches keep_at.  A null text has no words and fails the base rules, as does
    an empty one.  Very long texts are read whole.  Repeated rows are judged each; an
    empty table gives no rows.  carry names the columns to keep in record (all by
    default); inside it they cannot clash with the operator's own.
    """
    rows = recorded(docs, carry)
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return rows.mapInArrow(_score(model, keep_at), record_schema(rows, kinds))


def op1_ngram_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = judge_quality(docs, model, carry=["doc_id"])
    return found.select(F.col("record.doc_id").alias("doc_id"), *[c for c in found.columns if c != "record"])
