"""Sampled segmentations into pieces, without replacement, and their decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SAMPLES = 2
SEED = 29
BATCH_BYTES = 3 << 19
SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

U64 = np.uint64
TO_UNIT = float(2.0**-53)
#: No draw of a double adds more than NOISE to its location; nodes FAR below the first are
#: looked at only where that could matter.
NOISE, FAR = 42.0, 64.0
DRAWN = 1 << 14  # draws whose rows are held at once
BELOW_ONE = np.float32(1 - 2.0**-24)
NEAR_EDGE = np.float32(4e-6)  # where single precision may not tell which arc a draw falls on


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal draws wherever they are made."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _uniform(*parts) -> np.ndarray:
    x = np.asarray(parts[0], np.uint64)
    with np.errstate(over="ignore"):
        for p in parts[1:]:
            x = _mix(x * U64(0x9E3779B97F4A7C15) + np.asarray(p, np.uint64) + U64(1))
    return ((x >> U64(11)).astype(np.float64) + 0.5) * TO_UNIT


def _below(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at a location, given that they are below a bound."""
    g = location - np.log(-np.log(u))
    return np.where(np.isneginf(location), -np.inf, -np.logaddexp(-bound, -g))


class Pieces:
    """The model's pieces, their weights and how to find them.

    A piece's weight is the negative logarithm of its rank, as in Zipf's law; a byte
    weighs as much as the last piece.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        texts = [model.id_to_piece(k) for k in plain]
        self.most = max(map(len, texts))
        self.last = -float(np.log(n))
        weights = [-float(np.log(min(n, 1 - model.get_score(k)))) for k in plain]
        hashes = np.array([self.hash_of(t) for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain, np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece, and this tells at once
        slots = self._slot(self.hashes)
        self.maybe[slots] = True
        self.at_slot = np.zeros(1 << 20, np.int32)
        self.at_slot[slots] = np.arange(len(slots))
        self.crowded = np.bincount(slots.astype(np.int64), minlength=1 << 20) > 1  # slots of several pieces
        self.weight = np.full(n + 1, -np.inf, np.float32)
        self.weight[plain] = weights
        self.written = [b""] * n
        for k, t in zip(plain, texts):
            self.written[k] = t.replace(SPACE, " ").encode()
        for b, k in enumerate(self.bytes_):
            self.written[k] = bytes([b])
        self.sizes = np.fromiter(map(len, self.written), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.written), np.uint8)

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * 0x100000001B3 + ord(c) + 7) & ((1 << 64) - 1)
        return h

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * U64(0x9E3779B97F4A7C15)) >> U64(44)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids) of those of the flat hashes that are pieces."""
        slots = self._slot(hashes)
        at = np.flatnonzero(self.maybe[slots])
        slots, own = slots[at], hashes[at]
        near = self.at_slot[slots]
        several = np.flatnonzero(self.crowded[slots])
        near[several] = np.minimum(np.searchsorted(self.hashes, own[several]), len(self.ids) - 1)
        hit = self.hashes[near] == own
        return at[hit], self.ids[near[hit]]

    def decode(self, ids) -> bytes:
        """UTF-8 bytes of the text that was encoded; the leading space was added."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        out = self.letters[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        return out[1:] if out[:1] == b" " else out


class Lattices:
    """Arcs of all distinct chunks: at row base[chunk] + position, by arc length - 1.

    Chunks of one length stand together, so that they are filled in place.
    """

    def __init__(self, pieces: Pieces, chunks: list[str]) -> None:
        self.length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(self.length, kind="stable")
        sizes = self.length[order]
        ends = np.cumsum(sizes)
        rows, most = int(ends[-1]) if len(ends) else 0, pieces.most
        self.base = np.empty(len(chunks), np.int64)
        self.base[order] = ends - sizes
        self.codes = np.frombuffer("".join([chunks[k] for k in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.cumulative = np.ones((rows, most), np.float32)
        self.log_p = np.full((rows, most), -np.inf, np.float32)
        self.piece = np.full((rows, most), -1, np.int32)
        at = 0
        for n, m in zip(*np.unique(sizes, return_counts=True)):
            end = at + int(n) * int(m)
            self._fill(pieces, int(m), int(n), at, end)
            at = end
        self.sole = (self.piece != -1).sum(axis=1) == 1  # rows without a choice

    def _fill(self, pieces: Pieces, m: int, n: int, at: int, end: int) -> None:
        most = min(pieces.most, n)
        codes = self.codes[at:end].reshape(m, n).astype(np.uint64)
        weight, ids, cumulative = (x[at:end].reshape(m, n, -1) for x in (self.log_p, self.piece, self.cumulative))
        h = np.zeros((m, n), np.uint64)
        for k in range(most):
            h = h[:, : n - k] * U64(0x100000001B3) + codes[:, k:] + U64(7)
            places, found = pieces.find(h.ravel())
            row, col = np.divmod(places, n - k)
            ids[row, col, k] = found
            weight[row, col, k] = pieces.weight[found]
        lone = ids[:, :, 0] < 0  # no piece has this character: its bytes stand for it
        if lone.any():
            c = codes[lone]
            size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            weight[:, :, 0][lone] = size * np.float32(pieces.last)
            ids[:, :, 0][lone] = -2
        # logarithm of all ways from here to the end; arcs by chunks, so that steps run along the chunks
        rest = np.zeros((n + 1, m), np.float32)
        for i in range(n - 1, -1, -1):
            k = min(most, n - i)
            t = weight[:, i, :k].T + rest[i + 1 : i + 1 + k]
            top = t.max(axis=0)
            t -= top
            c = np.cumsum(np.exp(t), axis=0)
            total = c[-1].copy()
            c /= total
            np.log(total, out=total)
            rest[i] = top + total
            t -= total
            weight[:, i, :k] = t.T
            c[c >= 1 - 1e-7] = 1
            cumulative[:, i, :k] = c.T


class Path:
    """The decisions of one segmentation: lattice row, arc, probability, chunk, position."""

    def __init__(self, row, arc, log_p, chunk) -> None:
        self.row, self.arc, self.log_p, self.chunk = row, arc, log_p, chunk


def _exact_arcs(lattices: Lattices, row: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The arcs on which draws fall, by sums in double precision."""
    p = np.exp(lattices.log_p[row].astype(np.float64))
    c = np.cumsum(p, axis=1)
    arc = (u[:, None] * c[:, -1:] >= c).sum(axis=1)
    last = p.shape[1] - 1 - (p[:, ::-1] > 0).argmax(axis=1)
    return np.minimum(arc, last)


def _draw(lattices: Lattices, uids: np.ndarray, start: np.ndarray, seeds: np.ndarray):
    """Finish every chunk from its start by drawn arcs, all chunks a step at a time.

    Arcs are found in single precision; a draw that comes near an edge between two arcs
    is looked up again in double precision, so that arcs rarer than single precision
    shows are drawn as often as they should be.

    Returns (occurrence, row, arc, log_p) sorted by occurrence, then step.
    """
    base, length = lattices.base[uids], lattices.length[uids]
    flat, most = lattices.cumulative.ravel(), lattices.cumulative.shape[1]
    live = np.flatnonzero(start < length)
    pos = start.copy()
    who, rows, arcs = [], [], []
    step = 0
    while len(live):
        row = base[live] + pos[live]
        exact = _uniform(seeds[live], U64(step))
        u = np.minimum(exact.astype(np.float32), BELOW_ONE)
        arc = np.empty(len(live), np.int64)
        for at in range(0, len(live), DRAWN):
            below = u[at : at + DRAWN, None] >= lattices.cumulative.take(row[at : at + DRAWN], axis=0)
            count = np.bitwise_count(below.view(np.uint64))
            np.add(count[:, 0], count[:, 1], out=arc[at : at + DRAWN])
        np.minimum(arc, most - 1, out=arc)
        edge = row * most + arc
        doubt = flat.take(edge) - u <= NEAR_EDGE
        doubt |= u - flat.take(edge - (arc > 0)) <= NEAR_EDGE
        doubt = np.flatnonzero(doubt & ~lattices.sole.take(row))
        if len(doubt):
            arc[doubt] = _exact_arcs(lattices, row[doubt], exact[doubt])
        who.append(live)
        rows.append(row)
        arcs.append(arc)
        pos[live] += arc + 1
        live = live[pos[live] < length[live]]
        step += 1
    if not who:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(float)
    steps = [len(w) for w in who]
    step_of = np.repeat(np.arange(len(steps)), steps)
    who, rows, arcs = np.concatenate(who), np.concatenate(rows), np.concatenate(arcs)
    counts = np.bincount(who, minlength=len(uids))
    place = (np.cumsum(counts) - counts)[who] + step_of
    sorted_ = np.empty((2, len(who)), np.int64)
    sorted_[0, place], sorted_[1, place] = rows, arcs
    log_p = lattices.log_p.ravel().take(sorted_[0] * lattices.log_p.shape[1] + sorted_[1]).astype(np.float64)
    return np.repeat(np.arange(len(uids)), counts), sorted_[0], sorted_[1], log_p


class Numbers(dict):
    """Numbers its keys in the order in which they first come."""

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


class Sampler:
    """Distinct segmentations of texts in the order of their perturbed log-probabilities."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)

    def words(self, text: str) -> list[str]:
        """The text's parts that no piece crosses (spaces, then what is none), less their first space."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[-1] == " " or text[0] == " ":
            return [c[1:] for c in CHUNKS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def sample(self, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k (ids, log-probability, perturbed value, log of inclusion).

        The search tree has a level for each arc.  A node's perturbed value is the
        greatest below it, so that the queue's best node lies on the next segmentation;
        the siblings left aside at each of its arcs join the queue as one node, their
        greatest value drawn below that of their parent.
        """
        number = Numbers()
        uids = []
        for text in texts:
            parts = self.words(text)
            uids.append(np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)))
        lattices = Lattices(self.pieces, [SPACE + w for w in number])
        found: list[list] = [[] for _ in texts]
        queues: list[list] = [[] for _ in texts]
        tops = -np.log(-np.log(_uniform(keys, U64(1 << 40))))
        jobs = [(d, 0, 0, None, float(tops[d])) for d in range(len(texts))]
        for turn in range(k):
            self._run(lattices, uids, keys, jobs, turn, k, found, queues)
            jobs = []
            if turn + 1 < k:
                draws = [_uniform(keys, U64(turn + 1), U64(1 << bit)).tolist() for bit in (41, 42)]
                for d, queue in enumerate(queues):
                    if queue and not np.isneginf(queue[0][0]):
                        jobs.append(self._branch(lattices, d, heapq.heappop(queue), draws[0][d], draws[1][d], turn + 1, queue))
        out = []
        for d, ways in enumerate(found):
            rest = -queues[d][0][0] if queues[d] else -np.inf
            rows = []
            for path, top in ways:
                total = float(path.log_p.sum())
                rows.append((self._ids(lattices, path), total, top, self._inclusion(total - rest)))
            out.append(rows)
        return out

    @staticmethod
    def _inclusion(x: float) -> float:
        """log(1 - exp(-exp(x))): chance to be above the first value left out."""
        if x > 30:
            return 0.0
        return x - np.exp(x) / 2 if x < -12 else float(np.log(-np.expm1(-np.exp(x))))

    def _branch(self, lattices: Lattices, d: int, node, u: float, v: float, turn: int, queue: list):
        """The best of a node's siblings becomes the next segmentation's arc."""
        top, _, path, at, left_out = -node[0], node[1], node[2], node[3], node[4]
        row = int(path.row[at])
        p = np.exp(lattices.log_p[row].astype(float))
        p[list(left_out)] = 0
        c = np.cumsum(p)
        arc = int(min(np.searchsorted(c, u * c[-1], side="right"), np.flatnonzero(p)[-1]))
        before = float(path.log_p[:at].sum())
        p[arc] = 0
        after = p.sum()
        others = (*left_out, arc)
        if after > 0:
            value = float(_below(np.array(before + np.log(after)), np.array(top), np.array(v)))
            heapq.heappush(queue, (-value, turn, path, at, others))
        log_p = float(lattices.log_p[row, arc])
        head = Path(np.append(path.row[:at], row), np.append(path.arc[:at], arc), np.append(path.log_p[:at], log_p), np.append(path.chunk[:at], path.chunk[at]))
        chunk = int(path.chunk[at])
        return d, chunk, row + arc + 1, head, top

    def _run(self, lattices: Lattices, uids, keys, jobs, turn: int, k: int, found, queues) -> None:
        if not jobs:
            return
        own = [uids[d][chunk:] for d, chunk, _, _, _ in jobs]
        sizes = np.array([len(o) for o in own])
        flat = np.concatenate(own) if sizes.sum() else np.zeros(0, np.int64)
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        start = np.zeros(len(flat), np.int64)
        for j, (_, _, row, head, _) in enumerate(jobs):
            if head is not None:
                start[firsts[j]] = row - lattices.base[flat[firsts[j]]]
        job = np.repeat(np.arange(len(jobs)), sizes)
        chunk = np.arange(len(flat)) - firsts[job] + np.array([c for _, c, _, _, _ in jobs], np.int64)[job]
        own_key = np.array([keys[d] for d, *_ in jobs], np.uint64)
        with np.errstate(over="ignore"):
            seeds = _mix(_mix(own_key + U64(turn + 1))[job] + chunk.astype(np.uint64) * U64(0xD1B54A32D192ED03))
        who, row, arc, log_p = _draw(lattices, flat, start, seeds)
        cuts = np.searchsorted(job[who], np.arange(len(jobs) + 1)) if len(who) else np.zeros(len(jobs) + 1, np.int64)
        # values of the siblings, below the value of the way itself
        prefix = np.cumsum(log_p) - log_p
        heads = np.array([0.0 if h is None else h.log_p.sum() for *_, h, _ in jobs])
        tops = np.array([t for *_, t in jobs])
        part = job[who]
        near = values = np.zeros(0)
        if len(who):
            level = prefix - prefix[np.minimum(cuts[:-1], len(who) - 1)][part]
            near = np.flatnonzero(level >= -FAR)
            location = self._locations(lattices, row[near], arc[near], log_p[near]) + level[near]
            # a draw adds at most NOISE: enough greater ones make what is far away irrelevant
            enough = np.bincount(part[near], location >= NOISE - FAR, len(jobs)) >= k
            if not enough.all():
                near = np.flatnonzero((level >= -FAR) | ~enough[part])
                location = self._locations(lattices, row[near], arc[near], log_p[near]) + level[near]
            u = _uniform(_mix(own_key ^ U64(turn + (1 << 43)))[part[near]], near - cuts[part[near]])
            values = _below(location + heads[part[near]], tops[part[near]], u)
        ends = np.searchsorted(near, cuts)
        for j, (d, _, _, head, top) in enumerate(jobs):
            s, e = int(cuts[j]), int(cuts[j + 1])
            mine = Path(row[s:e], arc[s:e], log_p[s:e], chunk[who[s:e]])
            at = 0
            if head is not None:
                at = len(head.row)
                mine = Path(*(np.concatenate((getattr(head, n), getattr(mine, n))) for n in ("row", "arc", "log_p", "chunk")))
            found[d].append((mine, top))
            v, places = values[ends[j] : ends[j + 1]], near[ends[j] : ends[j + 1]]
            best = np.argpartition(-v, k - 1)[:k] if len(v) > k else np.arange(len(v))
            for b in best.tolist():
                if not np.isneginf(v[b]):
                    place = at + int(places[b]) - s
                    heapq.heappush(queues[d], (-float(v[b]), turn, mine, place, (int(mine.arc[place]),)))

    @staticmethod
    def _locations(lattices: Lattices, row: np.ndarray, arc: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Logarithm of the share of the arcs that were not taken."""
        aside = -np.expm1(log_p)
        sole = lattices.sole[row]
        small = np.flatnonzero((aside < 1e-3) & ~sole)  # where rounding shows, the others are added up
        if len(small):
            others = np.exp(lattices.log_p[row[small]].astype(np.float64))
            others[np.arange(len(small)), arc[small]] = 0
            aside[small] = others.sum(axis=1)
        aside[sole] = 0
        with np.errstate(divide="ignore"):
            return np.log(aside)

    def _ids(self, lattices: Lattices, path: Path) -> np.ndarray:
        ids = lattices.piece.ravel().take(path.row * lattices.piece.shape[1] + path.arc)
        lone = np.flatnonzero(ids == -2)
        if not len(lone):
            return ids
        out, last = [], 0
        for at in lone.tolist():
            out.append(ids[last:at])
            char = chr(int(lattices.codes[path.row[at]]))
            out.append(np.array([self.pieces.bytes_[b] for b in char.encode("utf-8", "replace")], np.int32))
            last = at + 1
        return np.concatenate([*out, ids[last:]])


_samplers: dict[str, Sampler] = {}


def _sampler(path: str) -> Sampler:
    if path not in _samplers:
        _samplers[path] = Sampler(path)
    return _samplers[path]


def _sample(path: str, k: int, seed: int, keep_ids: bool):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(path)
        names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "decoded", "ids"][: 8 + keep_ids]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            keys = np.asarray(batch.column("key")).view(np.uint64)
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_BYTES):
                    size += len(texts[end])
                    end += 1
                rows = []
                with np.errstate(over="ignore"):
                    ways = sampler.sample(texts[at:end], _mix(keys[at:end] + U64(seed)), k)
                for doc_id, text, own in zip(ids[at:end], texts[at:end], ways):
                    data = text.encode()
                    for r, (got, log_p, top, inclusion) in enumerate(own):
                        row = (doc_id, r + 1, len(got), zlib.crc32(got.astype("<u4").tobytes()), log_p, top, float(inclusion), sampler.pieces.decode(got) == data)
                        rows.append((*row, got) if keep_ids else row)
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
                at = end

    return sample


def sample_segmentations(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, seed: int = SEED, keep_ids: bool = True) -> DataFrame:
    """Up to `samples` distinct segmentations of every whole text of docs (doc_id, text).

    Returns doc_id, sample (from 1, by falling perturbed value), n_pieces, ids_crc32
    (little-endian unsigned 32-bit ids), log_prob, perturbed, log_inclusion, decoded
    (whether the ids decode to the text) and, unless keep_ids is off, ids.

    Segmentations are drawn without replacement, with the chance of their weights in the
    lattice of all pieces; log_inclusion is the logarithm of the chance to be among the
    samples given the greatest perturbed value left out.  Draws depend on doc_id, text
    and seed only, not on partitions or neighbours.  A text with fewer segmentations
    than samples gives them all, with inclusion 1; a null or empty text has one, the
    empty one.  A null doc_id is an id like any other; equal rows get equal samples; an
    empty table gives no rows.  A literal ▁ in a text decodes to a space, as the model
    takes it for one.  Other columns are not read.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, decoded boolean"
    return thin.mapInArrow(_sample(model, samples, seed, keep_ids), schema + ", ids array<int>" * keep_ids)


def decode_ids(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded's rows (doc_id, sample, ids) with the text that the ids stand for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _sampler(model).pieces
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], ["doc_id", "sample", "text"])

    return encoded.select("doc_id", "sample", "ids").mapInArrow(decode, "doc_id long, sample int, text string")


def op3_gumbel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with their ids."""
    return sample_segmentations(documents(spark, sf_dir))
