"""Near-duplicate embeddings: sign hashing, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import discard, written
from keyloom.llm.graph import connected_components

LEAST_COSINE = 0.95
SEED = 17
MISSED = 1e-3  # chance at most that a pair just at the least cosine meets in no table
PER_BUCKET = 128  # vectors a bucket would hold if directions were even
TILE = 8192  # vectors of a block; larger buckets are compared block against block
HEAD = 32  # bytes of signs that go with a vector's id into its buckets


def tables_for(rows: int, least_cosine: float = LEAST_COSINE, missed: float = MISSED) -> tuple[int, int]:
    """(tables, bits): bits grow with the logarithm of the rows, tables keep the recall."""
    bits = min(30, max(8, math.ceil(math.log2(max(rows, 1) / PER_BUCKET)) if rows > PER_BUCKET else 8))
    met = (1 - math.acos(least_cosine) / math.pi) ** bits
    return math.ceil(math.log(missed) / math.log(1 - met)), bits


def linkable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    flat /= np.abs(flat).max(axis=1, keepdims=True)  # no square over- or underflows
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _sign_codes(tables: int, bits: int, seed: int):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(batch.column("vector").value_lengths())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                signs = _unit(part.column("vector")) @ planes[dim] > 0
                code = (signs.reshape(len(part), tables, bits) @ (1 << np.arange(bits))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(code.ravel()))
                heads = np.packbits(signs[:, : 8 * HEAD], axis=1)
                heads = np.pad(heads, ((0, 0), (0, HEAD - heads.shape[1])))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([h.tobytes() for h in heads], pa.binary())], [*part.schema.names, "codes", "head"])

    return codes


def _tile_links(vectors: np.ndarray, codes: np.ndarray, weight: np.ndarray, block: np.ndarray, cross: bool, table: int, least: float):
    """(links of each row, root of each row) over pairs that no earlier table has compared; cross: of two blocks only."""
    n = len(vectors)
    left, right = [], []
    for at in range(0, n, 256):
        near = vectors[at : at + 256] @ vectors.T >= least
        a, b = np.nonzero(near)
        a += at
        ok = (b > a) & ((block[a] != block[b]) if cross else True)
        left.append(a[ok])
        right.append(b[ok])
    a, b = np.concatenate(left), np.concatenate(right)
    links = np.zeros(n, np.int64)
    root = np.arange(n)
    if len(a):
        if table:
            new = np.ones(len(a), bool)
            for s in range(0, len(a), 1 << 16):
                new[s : s + (1 << 16)] = ~(codes[a[s : s + (1 << 16)], :table] == codes[b[s : s + (1 << 16)], :table]).any(axis=1)
            a, b = a[new], b[new]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        while True:  # the smallest label in reach, by label passing and jumping
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
    return links, root


KEY = ["dim", "bucket", "code", "i", "j"]


def _by_tile(search):
    """search(rows) for every tile; tiles come sorted by KEY, and one that spans batches is kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def tiles(table: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if e - s > 1 and (out := search(table.slice(s, e - s))) is not None:
                    yield out

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            keys = np.stack([np.asarray(table.column(n)) for n in KEY], axis=1)
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from tiles(table.slice(0, cut), keys[:cut])
            kept = table.slice(cut)
        if kept is not None:
            yield from tiles(kept, np.zeros((len(kept), 1)))

    return run


def _crosses(part: pa.Table) -> bool:
    """Whether a tile is of two blocks, one of which may have no row here."""
    return part.column("i")[0].as_py() != part.column("j")[0].as_py()


def sign_limit(bits: int, least: float) -> int:
    """Different signs at most, of so many, for a pair at the least cosine: six deviations above the mean."""
    p = math.acos(least) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def _near_heads(bits: int, least: float):
    """The rows of a tile whose signs are near enough to another's for their cosine to be."""
    most = sign_limit(min(bits, 8 * HEAD), least)

    def search(part: pa.Table) -> pa.RecordBatch | None:
        words = np.frombuffer(b"".join(part.column("head").to_pylist()), np.uint64).reshape(len(part), -1)
        block = np.asarray(part.column("block"))
        cross = _crosses(part)
        near = np.zeros(len(part), bool)
        for at in range(0, len(part), 256):
            apart = sum(np.bitwise_count(words[at : at + 256, k, None] ^ words[None, :, k]).astype(np.uint16) for k in range(words.shape[1]))
            hit = apart <= most
            hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
            if cross:
                hit &= block[at : at + 256, None] != block[None, :]
            near[at : at + 256] |= hit.any(axis=1)
        if not near.any():
            return None
        return part.drop_columns(["head"]).filter(pa.array(near)).combine_chunks().to_batches()[0]

    return search


def _compare(least: float):
    def tile(part: pa.Table) -> pa.RecordBatch | None:
        node = part.column("class").combine_chunks()
        codes = np.asarray(part.column("codes").combine_chunks().flatten()).reshape(len(node), -1)
        vectors = _unit(part.column("vector").combine_chunks())
        table = part.column("bucket")[0].as_py()
        links, root = _tile_links(vectors, codes, np.asarray(part.column("weight")), np.asarray(part.column("block")), _crosses(part), table, least)
        hit = np.flatnonzero(links > 0)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([node.take(pa.array(hit)), pa.array(links[hit]), node.take(pa.array(root[hit]))], ["class", "links", "root"])

    return tile


def near_vectors(classes: DataFrame, least_cosine: float = LEAST_COSINE, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(class, links, root) parts over classes (class binary, vector array of numbers, weight long).

    Vectors whose signs agree on all hyperplanes of a table share a bucket.  First only
    ids and HEAD bytes of signs go there, and rows whose signs are too far from all
    others' drop out; only what is left fetches its vector, and all pairs of these in a
    bucket are compared exactly.  A pair that meets in several tables is counted in the
    first one only.  A bucket of more than `tile` vectors is dealt into blocks,
    and each pair of blocks is a task's work of its own, so that a bucket with a third of
    all rows is compared whole, by many tasks.  No pair leaves a tile: links comes as
    counts by vector, and root ties each linked vector to its group in the tile.
    """
    tables, bits = tables_for(classes.count(), least_cosine)
    kind = dict(classes.dtypes)["vector"]
    coded = written(classes.select("class", "vector", "weight").mapInArrow(_sign_codes(tables, bits, seed), f"class binary, vector {kind}, weight long, codes array<int>, head binary"), "codes")
    each = coded.select(F.size("vector").alias("dim"), "class", "head", F.posexplode("codes").alias("bucket", "code"))
    sizes = each.groupBy("dim", "bucket", "code").count()
    large = written(sizes.where(F.col("count") > tile).withColumn("blocks", F.ceil(F.col("count") / tile).cast("int")).drop("count"), "buckets")
    rows = each.join(large, ["dim", "bucket", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = rows.select(*KEY, "class", "block", "head").repartition(*KEY).sortWithinPartitions(*KEY)
    near = dealt.mapInArrow(_by_tile(_near_heads(tables * bits, least_cosine)), "dim int, bucket int, code int, i int, j int, class binary, block int")
    near = written(near, "near")
    whole = near.join(coded.select("class", "vector", "weight", "codes"), "class").repartition(*KEY).sortWithinPartitions(*KEY)
    found = written(whole.select(*KEY, "class", "vector", "weight", "codes", "block").mapInArrow(_by_tile(_compare(least_cosine)), "class binary, links long, root binary"), "links")
    discard(near, large, coded)
    return found


def _class(vector: Column) -> Column:
    """128 bits of hash: 10^10 different vectors share one by a chance of 10^-19."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), vector)), 16, "0") for k in (1, 2)]))


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df.

    n_links counts the other rows with cosine of at least least_cosine that are found;
    component_id is the smallest id reachable over such links, the row's own included.
    Equal vectors (by 128 bits of hash) are one class with a weight, so that copies are
    linked by counting.
    Null or zero vectors, those with null, NaN or infinite components and the empty
    vector link with nothing and are components of their own.  Vectors of different
    lengths never link.  A row with a null id counts as another row but names no
    component (kept is then false); rows with the same id count each.  An empty table
    gives no rows; other columns are not read.
    """
    own = dict(df.dtypes)[vector_col]
    kind = own if own == "array<float>" else "array<double>"
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    valid = vectors.where(linkable(F.col("vector")))
    alone = vectors.where(~linkable(F.col("vector")))
    keyed = valid.withColumn("class", _class(F.col("vector")))
    classes = keyed.groupBy("class").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    classes = written(classes, "vectors")
    found = near_vectors(classes, least_cosine)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = written(connected_components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))), "components")
    of_class = classes.select("class", "least", "weight").join(groups, F.col("class") == F.col("node"), "left").join(links, "class", "left")
    of_class = of_class.select("class", "least", F.coalesce("component", "class").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    of_class = written(of_class, "classes")
    discard(found, groups, classes)
    named = written(of_class.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    labels = written(of_class.join(named, "component").select("class", "n_links", "component_id"), "labels")
    rows = keyed.select("vec_id", "class").join(labels, "class").select("vec_id", "n_links", "component_id")
    rows = rows.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_sign_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector of embeddings."""
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows by comparing all pairs.
OP2_SQL = """with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, seen) as (select vec_id, vec_id from embeddings union select r.vec_id, l.b from r join l on l.a = r.seen),
n as (select a, count(*) as n from l group by a)
select r.vec_id, coalesce(any_value(n.n), 0)::bigint as n_links, min(seen) as component_id, r.vec_id = min(seen) as kept from r left join n on n.a = r.vec_id group by r.vec_id"""
