"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import documents, record_schema, recorded, texts_of, thin_batches

HIDDEN = 8
SEGMENT = 128  # bytes over which the network's state runs before it starts anew
BATCH = 512  # segments stepped together: few, as two networks' states of every byte are held
PAD = 256
UNDETERMINED = "und"
#: The training sample: about so many documents a language, and pieces of so many bytes of each.
TRAIN_DOCS, TRAIN_PIECES, TRAIN_BYTES = 250, 3, 64
STEPS, RATE, TRAIN_BATCH, SEED = 260, 0.02, 128, 11
REJECT_BELOW = 1.2  # times chance, which is 1 / number of languages


class Gru:
    """One direction: gates z and r, candidate n; h' = n + z (h - n).

    embed holds for each byte its share of the three pre-activations, biases included.
    """

    names = ("embed", "gates", "cand", "cand_bias")

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        self.hidden = hidden
        self.embed = (rng.standard_normal((PAD + 1, 3 * hidden)) * 0.3).astype(np.float32)
        self.embed[PAD] = 0
        self.embed[PAD, :hidden] = 30  # z is 1: what is no byte leaves the state alone
        self.gates = (rng.standard_normal((hidden, 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.cand = (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.cand_bias = np.zeros(hidden, np.float32)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States [time, batch, hidden] for bytes x [time, batch]."""
        k = self.hidden
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((*x.shape, k), np.float32)
        half = self.embed.copy()
        half[:, : 2 * k] *= 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        gates = self.gates * np.float32(0.5)
        for t in range(x.shape[0]):
            seen = half.take(x[t], axis=0)
            a = h @ gates
            a += seen[:, : 2 * k]
            np.tanh(a, out=a)
            a *= 0.5
            a += 0.5
            z, r = a[:, :k], a[:, k:]
            u = h @ self.cand
            u += self.cand_bias
            n = r * u
            n += seen[:, 2 * k :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, u, n))
            h = h - n
            h *= z
            h += n
            out[t] = h
        return out

    def backward(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time."""
        k = self.hidden
        grad = {name: np.zeros_like(getattr(self, name)) for name in self.names}
        dh = np.zeros((x.shape[1], k), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            h, z, r, u, n = keep[t]
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            da = np.concatenate((dh * (h - n) * z * (1 - z), dn * u * r * (1 - r)), axis=1)
            du = dn * r
            np.add.at(grad["embed"], x[t], np.concatenate((da, dn), axis=1))
            grad["gates"] += h.T @ da
            grad["cand"] += h.T @ du
            grad["cand_bias"] += du.sum(axis=0)
            dh = dh * z + da @ self.gates.T + du @ self.cand.T
        grad["embed"][PAD] = 0
        return grad


class Network:
    """Both directions and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.out = (rng.standard_normal((2 * hidden, len(languages))) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities [time, batch, language] for bytes x [time, batch]."""
        k = self.ahead.hidden
        logits = self.ahead.forward(x).reshape(-1, k) @ self.out[:k]
        logits += self.back.forward(x[::-1])[::-1].reshape(-1, k) @ self.out[k:]
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*x.shape, -1)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
        """Gradients of the mean cross-entropy over all bytes of x, each labelled y [batch]."""
        k, kept_a, kept_b = self.ahead.hidden, [], []
        ha = self.ahead.forward(x, kept_a)
        hb = self.back.forward(x[::-1], kept_b)[::-1]
        both = np.concatenate((ha, hb), axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = (x != PAD)[:, :, None]
        d = (p - np.eye(len(self.languages), dtype=np.float32)[y][None]) * real / max(1, real.sum())
        d = d.astype(np.float32)
        d_both = d @ self.out.T
        grad = {("", "out"): np.tensordot(both, d, ((0, 1), (0, 1))), ("", "bias"): d.sum(axis=(0, 1))}
        grad |= {("ahead", n): g for n, g in self.ahead.backward(x, kept_a, d_both[:, :, :k]).items()}
        grad |= {("back", n): g for n, g in self.back.backward(x[::-1], kept_b, d_both[::-1, :, k:]).items()}
        return grad

    def train(self, pieces: list[bytes], labels: np.ndarray, steps: int = STEPS, rate: float = RATE, batch: int = TRAIN_BATCH, seed: int = SEED) -> None:
        """Adam over batches that hold the languages evenly."""
        rng = np.random.default_rng(seed)
        width = max(map(len, pieces))
        table = np.full((len(pieces), width), PAD, np.int64)
        for row, piece in zip(table, pieces):
            row[: len(piece)] = np.frombuffer(piece, np.uint8)
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first: dict = {}
        second: dict = {}
        for turn in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, -(-batch // len(of))) for rows in of])
            for key, g in self.step(table[pick].T, labels[pick]).items():
                first[key] = 0.9 * first.get(key, 0) + 0.1 * g
                second[key] = 0.99 * second.get(key, 0) + 0.01 * g * g
                move = rate * min(1.0, 2 - 2 * turn / steps) * (first[key] / (1 - 0.9**turn)) / (np.sqrt(second[key] / (1 - 0.99**turn)) + 1e-8)
                owner = getattr(self, key[0]) if key[0] else self
                setattr(owner, key[1], (getattr(owner, key[1]) - move).astype(np.float32))

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean of its bytes' probabilities, all bytes of it read."""
        total = np.zeros((len(texts), len(self.languages)))
        size = np.array([len(t) for t in texts])
        pieces = [(k, t[at : at + SEGMENT]) for k, t in enumerate(texts) for at in range(0, len(t), SEGMENT)]
        pieces.sort(key=lambda p: len(p[1]))  # so that little is padded
        for at in range(0, len(pieces), BATCH):
            some = pieces[at : at + BATCH]
            width = len(some[-1][1])
            x = np.frombuffer(b"".join(p.ljust(width, b"\0") for _, p in some), np.uint8).reshape(len(some), width).T.astype(np.int64)
            real = np.arange(width)[:, None] < np.array([len(p) for _, p in some])
            x[~real] = PAD
            p = self.positions(x)
            p *= real[:, :, None]
            np.add.at(total, [k for k, _ in some], p.sum(axis=0))
        return total / np.maximum(size, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_pieces(docs: DataFrame, docs_each: int = TRAIN_DOCS, pieces: int = TRAIN_PIECES, size: int = TRAIN_BYTES) -> tuple[list[str], list[bytes], np.ndarray]:
    """(languages, pieces, labels): a bounded, seeded sample of the labelled documents.

    A document is drawn by a hash of its id with its language's own share, so that
    about docs_each documents of each language come to the driver, a few short pieces
    of each.  Every language is learned, so the sample grows with their number only.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").count().collect()
    share = {r["lang"]: min(1.0, docs_each / r["count"]) for r in counts}
    languages = sorted(share)
    if not languages:
        return [], [], np.zeros(0, int)
    table = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    data = F.col("text").cast("binary")
    room = F.greatest(F.length(data) - size, F.lit(0)) + 1
    cut = [F.substring(data, (F.pmod(F.xxhash64(F.lit(k), "doc_id"), room) + 1).cast("int"), F.lit(size)) for k in range(pieces)]
    rows = usable.where(draw < table[F.col("lang")]).select("lang", F.array_distinct(F.array(*cut)).alias("cut")).collect()
    found = sorted((languages.index(r["lang"]), bytes(p)) for r in rows for p in r["cut"] if len(p))
    return languages, [p for _, p in found], np.array([k for k, _ in found], int)


def train(docs: DataFrame) -> Network | None:
    """A network fitted to a sample of docs, or None if nothing is labelled."""
    languages, pieces, labels = training_pieces(docs)
    there = sorted({*labels.tolist()})
    if not there:
        return None
    network = Network([languages[k] for k in there])
    network.train(pieces, np.searchsorted(there, labels))
    return network


def reject_below(network: Network | None) -> float:
    """The score under which a language is no better than a guess; a sole language is never rejected."""
    n = len(network.languages) if network else 0
    return REJECT_BELOW / n if n > 1 else 0.0


def _label(network: Network | None):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thin_batches(batches):
            lang, score = [UNDETERMINED] * len(batch), np.zeros(len(batch))
            letters = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool)
            rows = np.flatnonzero(letters).tolist() if network else []
            data = texts_of(batch)
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                p = network.pool([data[k].as_buffer().to_pybytes() for k in some])
                for k, row in zip(some, p):
                    lang[k], score[k] = network.languages[int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(lang, pa.string()), pa.array(score)], ["record", "lang_pred", "score"])

    return label


def identify(docs: DataFrame, network: Network | None, carry: list[str] | None = None) -> DataFrame:
    """docs' rows as (record struct, lang_pred, score).

    Only text is an input.  Its whole bytes run through the network in segments, every
    byte gets a probability for each language, and their mean is the document's: score
    is that of the best, ties going to the language that comes first in order.  A null
    text, or one without a letter, is `und` with score 0; so is every text if nothing was
    learned.  Repeated rows get the same answer; an empty table gives no rows.  carry
    names the columns to keep in record, where they cannot clash with these.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = recorded(docs, carry, letters)
    return rows.mapInArrow(_label(network), record_schema(rows, "lang_pred string, score double"))


def op5_bidirectional_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs, train(docs), carry=["doc_id"])
    doc_id = F.col("record.doc_id")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score")
