"""Token ids in training order: a keyed permutation and fixed-stride shards."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.common import documents, shared_dir, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_ID = 50256
LENGTH = 1024  # tokens of a sequence
STRIDE = 4 + 2 * LENGTH  # a record: used tokens as an unsigned 32-bit number, then 16-bit ids
PER_SHARD = 4096
PER_TASK = 16_384  # records that a task puts in order, about 32 MB
PER_BLOCK = 256  # records of a row of a shard
TEXT_BYTES = 256 << 20  # of a range of documents that is numbered in one go
KEY = 0x5EED_0F_0EDE
ROUNDS = 6
#: Of a block of a shard; its shard is the folder it stands in.
BLOCK = "first_slot long, records int, payload binary, doc_ids array<long>, parts array<int>"
CODEC = "zstd"  # what ids are stored with; it takes a sixth less than the default

_encodings: dict[str, tiktoken.Encoding] = {}


def _encoding(path: str) -> tiktoken.Encoding:
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _records(path: str, length: int, end_id: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        names = ["doc_id", "part", "n_tokens", "record"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids = np.append(encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32), end_id).astype("<u2")
                for part, at in enumerate(range(0, len(ids), length)):
                    own = ids[at : at + length]
                    body = own if len(own) == length else np.pad(own, (0, length - len(own)), constant_values=end_id)
                    rows.append((doc_id, part, len(own), len(own).to_bytes(4, "little") + body.tobytes()))
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return records


def permuted(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index in a keyed permutation of 0 .. n-1.

    A balanced Feistel network permutes the smallest power of four that holds n; values
    outside 0 .. n-1 walk on along their cycle until they are inside, fewer than four
    steps on average.
    """
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(rounds):
            h = right + np.uint64((key + 0x9E3779B97F4A7C15 * (turn + 1)) & ((1 << 64) - 1))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def slot_of(index: Column, n: int, key: int = KEY) -> Column:
    """permuted() of a column; only the index goes to Python, whatever else the rows hold."""

    def slots(index: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(permuted(index.to_numpy(), n, key))

    return F.pandas_udf(slots, "long")(index)


def in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges of doc_id, then the text's hash, each range sorted.

    Rows of one id and text come in any order, as nothing tells them apart; their place
    in the input parts them into ranges, so that many of them are not one task's work.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("at"))
    return rows.repartitionByRange(ranges, "doc_id", "hash", "at").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")


def numbered(table: DataFrame) -> tuple[DataFrame, int]:
    """A table written in order, with a gapless index from 0 in that order, and its rows.

    A row's index is its place in its file after the rows of the files before it, so
    that only one row a file is put in order.  Files go by their parts' numbers.
    """
    rows = table.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    sizes = written(rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows")), "files")
    before = Window.orderBy(F.regexp_extract("file", "^part-([0-9]+)", 1).cast("long")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    total = sizes.agg(F.sum("rows").alias("n")).first()["n"] or 0
    return rows.join(starts, "file").withColumn("index", F.col("first") + F.col("at")).drop("file", "at", "first"), total


def _blocks(per_block: int, per_shard: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joins records, which come in slot order, to rows of per_block records."""
        held: list[tuple[int, bytes, int | None, int]] = []

        def row() -> pa.RecordBatch:
            slots, records, doc_ids, parts = zip(*held)
            cols = [[slots[0] // per_shard], [slots[0]], [len(held)], [b"".join(records)], [doc_ids], [parts]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "first_slot", "records", "payload", "doc_ids", "parts"])

        for batch in batches:
            for slot, record, doc_id, part in zip(batch.column("slot").to_pylist(), batch.column("record"), batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()):
                if held and slot // per_block != held[0][0] // per_block:
                    yield row()
                    held.clear()
                held.append((slot, record.as_buffer().to_pybytes(), doc_id, part))
        if held:
            yield row()

    return blocks


def training_order(docs: DataFrame, ranks: str = RANKS, length: int = LENGTH, end_id: int = END_ID, key: int = KEY) -> DataFrame:
    """(doc_id, part, n_tokens, record, slot) for every sequence of docs (doc_id, text).

    A document's ids, then end_id, are cut into sequences of `length` tokens; the last is
    padded with end_id and n_tokens tells its own.  record has a fixed stride of 4 + 2 x
    length bytes.  slot is the sequence's place in training order: its place among all
    sequences by document id, text and part, put through a keyed permutation of 0 .. n-1
    without gaps.  The same documents and key give the same order, however the table is
    split.

    A null or empty text is one sequence of the end id alone.  Null ids, which come first,
    and repeated rows get sequences of their own; rows of the same id and text share
    their places in any way.  An empty table gives no rows.  Other columns are not read.
    """
    thin = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    table = written(thin.mapInArrow(_records(ranks, length, end_id), "doc_id long, part int, n_tokens int, record binary"), "sequences", compression=CODEC)
    rows, n = numbered(table)
    return rows.select("doc_id", "part", "n_tokens", "record", slot_of(F.col("index").cast("long"), n, key).alias("slot"))


def shard_blocks(ordered: DataFrame, per_shard: int = PER_SHARD, per_block: int = PER_BLOCK) -> DataFrame:
    """(shard, first_slot, records, payload, doc_ids, parts): the shards' bytes in slot order, and whose they are.

    Tasks own ranges of blocks, so that a block is never divided; per_block must divide
    per_shard.  Slot s is at byte (s - first_slot) x stride of its block's payload.
    """
    if per_shard % per_block:
        raise ValueError("per_block must divide per_shard")
    block = F.expr(f"slot div {per_block}")
    tasks = max(4 * ordered.sparkSession.sparkContext.defaultParallelism, -(-ordered.count() // PER_TASK))
    spread = ordered.select("slot", "record", "doc_id", "part", block.alias("block")).repartitionByRange(tasks, "block").sortWithinPartitions("slot")
    return spread.drop("block").mapInArrow(_blocks(per_block, per_shard), f"shard long, {BLOCK}")


def write_shards(ordered: DataFrame, path: str) -> None:
    """Write shard_blocks as Parquet, a folder a shard; the committer makes retries safe."""
    shard_blocks(ordered).write.partitionBy("shard").parquet(path, compression=CODEC)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The blocks that write_shards left in path."""
    return spark.read.schema(f"{BLOCK}, shard long").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, per_shard: int = PER_SHARD, stride: int = STRIDE) -> DataFrame:
    """(slot, n_tokens, ids) from a slot on, as a resumed reader takes them.

    Shards before the slot's are pruned by folder, and records before it are skipped by
    their fixed stride.
    """
    blocks = stored(spark, path).where((F.col("shard") >= slot // per_shard) & (F.col("first_slot") + F.col("records") > slot))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column("first_slot").to_pylist(), batch.column("payload").to_pylist()):
                table = np.frombuffer(data, np.uint8).reshape(-1, stride)
                skip = max(0, slot - first)
                used = table[skip:, :4].copy().view("<u4")[:, 0]
                ids = table[skip:, 4:].copy().view("<u2")
                slots = np.arange(first + skip, first + len(table))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(used.astype(np.int32)), pa.array([r[:n].astype(np.int32) for r, n in zip(ids, used)], pa.list_(pa.int32()))], ["slot", "n_tokens", "ids"])

    return blocks.select("first_slot", "payload").mapInArrow(unpack, "slot long, n_tokens int, ids array<int>")


def _digests(per_shard: int, stride: int):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "part", "n_tokens", "slot", "shard", "byte_offset", "record_crc32"]
        for batch in batches:
            for first, data, doc_ids, parts in zip(*(batch.column(c).to_pylist() for c in ("first_slot", "payload", "doc_ids", "parts"))):
                at = range(0, len(data), stride)
                slots = np.arange(first, first + len(at))
                used = [int.from_bytes(data[a : a + 4], "little") for a in at]
                sums = [zlib.crc32(data[a : a + stride]) for a in at]
                owners = [pa.array(doc_ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(used, pa.int32())]
                places = [slots, slots // per_shard, slots % per_shard * stride, np.array(sums, np.int64)]
                yield pa.RecordBatch.from_arrays([*owners, *map(pa.array, places)], names)

    return digests


def op4_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of every document: its slot, and what its stored shard holds there.

    The shards stay in the shared folder, for read_from; the digests are of what is read
    back from them.
    """
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(training_order(documents(spark, sf_dir)), path)
    schema = "doc_id long, part int, n_tokens int, slot long, shard long, byte_offset long, record_crc32 long"
    return stored(spark, path).select("first_slot", "payload", "doc_ids", "parts").mapInArrow(_digests(PER_SHARD, STRIDE), schema)
