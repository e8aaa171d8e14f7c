"""Best-fit packing of documents into token sequences after dominance reduction."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from keyloom.llm.common import documents, thin_batches, written

CAPACITY = 2048
END_ID = 0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PER_GROUP = 1 << 20  # pieces that are put in order at once
#: Encoded words after which a Python worker lets go of those that did not come again (it
#: keeps up to twice as many), and texts that it cuts at once.
CACHED_WORDS = 160_000
CUT_AT_ONCE = 512
#: Fixed values of the tokenizer: how it divides a word, and how its model writes bytes
#: that are not printable ASCII.
LETTERS, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"  # of Latin-1, lower case
WORD_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: What is neither printable Latin-1 nor plain white space; where Python and the tokenizer disagree about that.
UNUSUAL = re.compile("[^ -~\t-\r\xa0-¬®-ÿ]")
ODD = re.compile("[\x1c-\x1f\x85]")

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
IDS = ", ids array<int>"


class Learned(dict):
    """A dictionary that works out what it does not hold yet, and keeps what comes again."""

    def __init__(self, learn) -> None:
        self.learn = learn
        self.before: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.pop(key, None)
        if value is None:
            value = self.learn(key)
        self[key] = value
        return value

    def limit(self, most: int) -> None:
        """Beyond most, let go of what was not asked for since the last time."""
        if len(self) > most:
            self.before = dict(self)
            self.clear()


class WordEncoder:
    """Token ids of whole texts, word by word.

    The tokenizer drops white space and never joins what white space divides, so that
    the ids of a text are those of its words in turn; words that come again are not
    encoded again.  Words of printable Latin-1, where lower-casing and normal form are
    plain, are lower-cased at once for a whole text, and their parts go straight to the
    tokenizer's model; all other words, and texts with a special token or a control
    character on which Python and the tokenizer disagree about white space, take the
    tokenizer's whole way.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Learned(self._word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        """Ids of a word, which is in lower case if it is printable Latin-1."""
        if UNUSUAL.search(word):
            return self._whole(word)
        parts = WORD_PARTS.findall(word)
        return b"".join(map(self.words.__getitem__, parts)) if len(parts) > 1 else self._part(word)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        for text in texts:
            if ODD.search(text) or any(t in text for t in self.special):
                yield self._whole(text)
                continue
            self.words.limit(CACHED_WORDS)
            if UNUSUAL.search(text):
                words = [w if UNUSUAL.search(w) else w.lower() for w in text.split()]
            else:
                words = text.lower().split()
            yield b"".join(map(self.words.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for part in thin_batches(batches, CUT_AT_ONCE):
            texts = [x.as_py() or "" for x in part.column(1)]
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    row = (doc_id, piece, start, len(own) // 4, zlib.crc32(own))
                    rows.append((*row, np.frombuffer(own, "<u4").astype("<i4")) if keep_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return cut


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """The ids of every whole text, then end_id, in pieces of at most capacity tokens."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(_cut(tokenizer, capacity, end_id, keep_ids), PIECES + IDS * keep_ids)


class Plan:
    """Sequences by the lengths they hold, for a histogram of lengths.

    Equal items are interchangeable, so that a plan of runs of equal sequences says
    where the r-th item of each length goes.  Its size is bounded by the capacity, not
    by the number of items.
    """

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.capacity = capacity
        self.left = counts.astype(np.int64).copy()  # by length
        self.taken = np.zeros_like(self.left)
        self.sequences = 0
        self.fixed = 0
        #: (length, first rank, ranks, first sequence, items in each, offset)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._reduce()
        self._best_fit()

    def _place(self, length: int, bins: int, first: int, each: int, offset: int) -> None:
        self.runs.append((length, int(self.taken[length]), bins * each, first, each, offset))
        self.taken[length] += bins * each
        self.left[length] -= bins * each

    def _new(self, lengths: list[int], bins: int) -> None:
        offset = 0
        for length in lengths:
            self._place(length, bins, self.sequences, 1, offset)
            offset += length
        self.sequences += bins
        self.fixed += bins

    def _largest(self, most: int) -> int:
        there = np.flatnonzero(self.left[: most + 1] > 0) if most > 0 else ()
        return int(there[-1]) if len(there) else 0

    def _smallest(self, k: int) -> int:
        """Total of the k smallest items left, or more than any room if there are fewer."""
        total = 0
        for length in np.flatnonzero(self.left > 0):
            use = min(k, int(self.left[length]))
            total, k = total + use * int(length), k - use
            if not k:
                return total
        return self.capacity + 1

    def _dominating(self, length: int) -> list[int]:
        """A set with an item of this length that dominates every other such set, or nothing.

        The item itself is set aside while its companions are looked for.
        """
        room = self.capacity - length
        single = self._largest(room)
        if not single or single == room or self._smallest(2) > room:
            return [length, single] if single else [length]
        if self._smallest(3) <= room:
            return []
        self.left[single] -= 1
        second = self._largest(room - single)
        self.left[single] += 1
        pairs = 0
        for a in np.flatnonzero(self.left[: room + 1] > 0).tolist():
            self.left[a] -= 1
            b = self._largest(room - a)
            self.left[a] += 1
            pairs = max(pairs, a + b if b else 0)
        if single >= pairs:
            return [length, single]
        if second and second >= self._largest(room // 2):
            return [length, single, second]
        return []

    def _reduce(self) -> None:
        """Fix sets that dominate, largest items first, until no length changes."""
        half = self.capacity // 2
        for length in range(self.capacity, half, -1):  # two that fill a sequence always dominate
            pair = self.capacity - length
            if pair and (n := int(min(self.left[length], self.left[pair]))):
                self._new([length, pair], n)
            if not pair and self.left[length]:
                self._new([length], int(self.left[length]))
        if self.capacity % 2 == 0 and self.left[half] > 1:
            n = int(self.left[half] // 2)
            self._place(half, n, self.sequences, 2, 0)
            self.sequences += n
            self.fixed += n
        changed = True
        while changed:
            changed = False
            for length in range(self.capacity, 0, -1):
                while self.left[length] > 0:
                    self.left[length] -= 1
                    found = self._dominating(length)
                    self.left[length] += 1
                    if not found:
                        break
                    uses = {x: found.count(x) for x in found}
                    times = min(int(self.left[x] // k) for x, k in uses.items())
                    # what holds once holds while the same lengths remain
                    self._new_repeated(found, uses, max(1, times - 1))
                    changed = True
                if self.left[length] > 0 and self._smallest(3) <= self.capacity - length:
                    break  # smaller items have still more room

    def _new_repeated(self, found: list[int], uses: dict[int, int], bins: int) -> None:
        offset = 0
        for length, k in uses.items():
            self._place(length, bins, self.sequences, k, offset)
            offset += k * length
        self.sequences += bins
        self.fixed += bins

    def _best_fit(self) -> None:
        """Longest first, each into the fullest sequence that has room."""
        open_: dict[int, list[tuple[int, int]]] = {}  # by room: runs of (first sequence, sequences)
        rooms: list[int] = []

        def put(room: int, run: tuple[int, int]) -> None:
            if room and run[1]:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append(run)

        for length in range(self.capacity, 0, -1):
            while (n := int(self.left[length])) > 0:
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    each = self.capacity // length
                    put(self.capacity, (self.sequences, -(-n // each)))
                    self.sequences += -(-n // each)
                    continue
                room = rooms[at]
                first, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                each = room // length
                offset = self.capacity - room
                full = min(bins, n // each)
                if full:
                    self._place(length, full, first, each, offset)
                    put(room - each * length, (first, full))
                rest = min(n - full * each, each) if full < bins else 0
                if rest:
                    self._place(length, 1, first + full, rest, offset)
                    put(room - rest * length, (first + full, 1))
                put(room, (first + full + bool(rest), bins - full - bool(rest)))


def _runs(plan: Plan, spark: SparkSession) -> DataFrame:
    """(length, first, next, sequence, each, at): where the pieces of a length from rank first up to next go."""
    runs = np.array(sorted(map(tuple, plan.runs)), np.int64).reshape(-1, 6)
    same = np.append(runs[1:, 0] == runs[:-1, 0], False)[: len(runs)]
    after = np.where(same, np.append(runs[1:, 1], 0)[: len(runs)], (1 << 63) - 1)
    table = pa.table({"of_length": runs[:, 0], "run_first": runs[:, 1], "run_next": after, "run_sequence": runs[:, 3], "run_each": np.maximum(runs[:, 4], 1), "run_at": runs[:, 5]})
    return spark.createDataFrame(table)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length 1..capacity, doc_id, piece) plus sequence_id and offset.

    The histogram of lengths (one row a length) is all that the driver sees.  On it,
    sets that dominate all alternatives are fixed first (Martello and Toth), and what
    is left goes best fit, longest first.  The plan comes back as at most a few runs a
    length, so it is small whatever the corpus, and every task looks its pieces up in
    it by their rank among pieces of their length.  Ranks are counted in (length, salt)
    groups of about PER_GROUP pieces, so that no task holds all pieces of a common length.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    salts = [(n, int(c) // PER_GROUP + 1) for n, c in enumerate(histogram.tolist()) if c]
    salts = F.broadcast(pieces.sparkSession.createDataFrame(salts, f"length {dict(pieces.dtypes)['length']}, salts int"))  # capacity rows at most
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts").cast("int")).drop("salts")
    counts = written(salted.groupBy("length", "salt").count(), "lengths")
    plan = Plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    in_group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(in_group) - 1)
    # a row for PER_GROUP pieces, and one a length
    ranked = ranked.join(F.broadcast(starts), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))
    # what the plan says is joined, not looked up in Python, as pieces may carry their ids
    there = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("run_first")) & (F.col("rank") < F.col("run_next"))
    met = ranked.join(F.broadcast(_runs(plan, pieces.sparkSession)), there).withColumn("nth", F.col("rank") - F.col("run_first"))
    sequence = F.col("run_sequence") + F.expr("nth div run_each")
    offset = F.col("run_at") + F.col("nth") % F.col("run_each") * F.col("length")
    return met.select(*pieces.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pack every document of docs (doc_id, text) into sequences of at most capacity tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, ids (unless
    keep_ids is off), sequence_id, offset.  A null or empty text is just the end id.  A
    null doc_id and repeated rows are packed like any other; ties between equal lengths
    go by doc_id, piece and content.  An empty table gives no rows.  Other columns are
    not read, so that their names cannot clash.
    """
    return pack(written(token_pieces(docs, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2048 tokens."""
    packed = pack_documents(documents(spark, sf_dir), keep_ids=False)
    return packed.withColumn("length", F.col("length").cast("long"))
