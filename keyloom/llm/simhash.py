"""SimHash near-duplicates over a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import documents, thin_batches, written
from keyloom.llm.graph import connected_components

SHINGLE = 3
HASH_SEED = 42
MAX_BITS = 2
LEAF = 16  # fingerprints under one lowest node of the index
FAN = 4  # neighbouring nodes under one upper node
SEGMENT = 1024  # fingerprints of a row: small enough for Arrow batches, large enough for a tree
BLOCK_BITS = 10, 20  # a block holds 2**10 to 2**20 fingerprints, 8 MB: what a task searches in
BLOCKS = 1 << 16  # blocks at most, 24 bytes each for every task; beyond, the blocks grow instead
FRONTIER = 1 << 12  # pairs of leaves compared at once


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's UTF-8 bytes.

    A-Z are lower-cased; words are runs of anything but space and \\t \\n \\v \\f \\r.
    Fewer words than a shingle make one shingle; no word gives 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds what a very long text holds at once
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + shingle - 1 :].tolist())
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in thin_batches(batches):
        prints = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(prints.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp long): the SimHash of every whole text; a null text has no words.  hashed adds the text's hash."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *[F.xxhash64(text_col).alias("hash")] * hashed)
    return thin.mapInArrow(_fingerprints, f"doc_id {dict(thin.dtypes)['doc_id']}, fp long" + ", hash long" * hashed)


def gray_rank(fp: Column) -> Column:
    """Place of each code in the binary reflected Gray order, as a signed number in the same order."""
    steps = F.array(*[F.lit(k) for k in (1, 2, 4, 8, 16, 32)])
    rank = F.aggregate(steps, fp, lambda r, k: r.bitwiseXOR(F.call_function("shiftrightunsigned", r, k)))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class Tree:
    """A hierarchical index over codes in Gray order.

    Neighbours in Gray order agree in most leading bits.  A leaf holds LEAF neighbouring
    codes, an upper node FAN neighbouring nodes; each keeps the mask of the bits that all
    codes below it share, and their pattern.  The last level is a single root.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        short = -len(codes) % LEAF
        leaves = np.append(codes, np.repeat(codes[-1:], short)).reshape(-1, LEAF)
        self.leaves = leaves
        levels = [(np.bitwise_and.reduce(leaves, axis=1), np.bitwise_or.reduce(leaves, axis=1))]
        while len(levels[-1][0]) > 1:
            ends = np.arange(0, len(levels[-1][0]), FAN)
            levels.append((np.bitwise_and.reduceat(levels[-1][0], ends), np.bitwise_or.reduceat(levels[-1][1], ends)))
        self.levels = [(~(every ^ some), every) for every, some in levels]


def _children(level: int, nodes: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(which of nodes, child) one level down."""
    of = np.repeat(np.arange(len(nodes)), FAN)
    child = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    held = child < len(tree.levels[level - 1][0])
    return of[held], child[held]


def near_pairs(a: Tree, b: Tree, max_bits: int, pruned: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in a and b of codes with at most max_bits different bits; i < j if a is b.

    Both trees are walked from their roots, a group against a group.  Each step adds up
    what the newly shared bits of the two groups differ in; with more than max_bits the
    two groups are left, with all the pairs below them.  pruned, if given, counts these
    by the level of the higher group, leaves at 0.
    """
    same = a is b

    def walk(la: int, lb: int, x: np.ndarray, y: np.ndarray, so_far: np.ndarray, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (mask_a, own_a), (mask_b, own_b) = a.levels[la], b.levels[lb]
        shared = mask_a[x] & mask_b[y]
        so_far = so_far + np.bitwise_count((own_a[x] ^ own_b[y]) & shared & ~seen)
        near = so_far <= max_bits
        if pruned is not None:
            pruned[max(la, lb)] += int((~near).sum())
        x, y, so_far, seen = x[near], y[near], so_far[near], shared[near]
        for at in range(0, len(x), FRONTIER):
            part = slice(at, at + FRONTIER)
            yield from down(la, lb, x[part], y[part], so_far[part], seen[part])

    def down(la, lb, x, y, so_far, seen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if la == lb == 0:
            free = (a.leaves[x][:, :, None] ^ b.leaves[y][:, None, :]) & ~seen[:, None, None]
            k, i, j = np.nonzero(so_far[:, None, None] + np.bitwise_count(free) <= max_bits)
            i, j = x[k] * LEAF + i, y[k] * LEAF + j
            held = (i < len(a.codes)) & (j < len(b.codes)) & ((i < j) if same else True)
            yield i[held], j[held]
            return
        ka, kb = max(la, lb) == la > 0, max(la, lb) == lb > 0  # the higher group is opened, or both
        if ka:
            of, x = _children(la, x, a)
            y, so_far, seen = y[of], so_far[of], seen[of]
        if kb:
            of, y = _children(lb, y, b)
            x, so_far, seen = x[of], so_far[of], seen[of]
        if same:
            once = x <= y
            x, y, so_far, seen = x[once], y[once], so_far[once], seen[once]
        yield from walk(la - ka, lb - kb, x, y, so_far, seen)

    root = np.zeros(1, np.int64)
    yield from walk(len(a.levels) - 1, len(b.levels) - 1, root, root, np.zeros(1, np.uint8), np.zeros(1, np.uint64))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest one that links (a, b) reach, by passing labels and jumping."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for x in (a, b, root[a], root[b]):
            np.minimum.at(root, x, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _segments(block: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes come in Gray order; each row holds SEGMENT of them, and the block they are in."""
        names = ["block", "every", "some", "codes"]
        held, size, name = np.zeros(0, np.uint64), 0, 0

        def rows(whole: np.ndarray) -> pa.RecordBatch:
            nonlocal size, name
            out: list[list] = [[], [], [], []]
            for at in range(0, len(whole), SEGMENT):
                part = whole[at : at + SEGMENT]
                if size == 0:
                    name = int(part[:1].view(np.int64)[0])  # a block goes by its first code
                for x, v in zip(out, (name, int(np.bitwise_and.reduce(part).astype(np.int64)), int(np.bitwise_or.reduce(part).astype(np.int64)), part.tobytes())):
                    x.append(v)
                size = (size + len(part)) % block
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(out[3], pa.binary())], names)

        for batch in batches:
            held = np.concatenate((held, np.asarray(batch.column(0)).view(np.uint64)))
            cut = len(held) // SEGMENT * SEGMENT
            yield rows(held[:cut])
            held = held[cut:]
        yield rows(held)

    return segments


def _routes(names: np.ndarray, every: np.ndarray, some: np.ndarray, max_bits: int):
    """Each segment to every block that may hold a code near one of its own, its own block first.

    The blocks' nodes, with upper nodes above them, are the top of the index.  Of two
    blocks the earlier one's segments go to the later one.
    """
    levels = [(every, some)]
    while len(levels[-1][0]) > 1:
        ends = np.arange(0, len(levels[-1][0]), FAN)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], ends), np.bitwise_or.reduceat(levels[-1][1], ends)))
    nodes = [(~(e ^ s), e) for e, s in levels]
    place = {int(n): k for k, n in enumerate(names)}

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([place[b] for b in batch.column("block").to_pylist()], np.int64)
            all_, any_ = (np.asarray(batch.column(c)).view(np.uint64) for c in ("every", "some"))
            mask = ~(all_ ^ any_)
            x, y = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            so_far, seen = np.zeros(len(batch), np.uint8), np.zeros(len(batch), np.uint64)
            for level in range(len(nodes) - 1, -1, -1):
                masks, pattern = nodes[level]
                shared = mask[x] & masks[y]
                so_far = so_far + np.bitwise_count((all_[x] ^ pattern[y]) & shared & ~seen)
                near = (so_far <= max_bits) & (y >= own[x] // FAN**level)  # later blocks only
                x, y, so_far, seen = x[near], y[near], so_far[near], shared[near]
                if level:
                    of = np.repeat(np.arange(len(y)), FAN)
                    child = (y[:, None] * FAN + np.arange(FAN)).ravel()
                    held = child < len(nodes[level - 1][0])
                    x, y, so_far, seen = x[of[held]], child[held], so_far[of[held]], seen[of[held]]
            for at in range(0, len(x), 4096):
                part = slice(at, at + 4096)
                visits = y[part] != own[x[part]]
                yield pa.RecordBatch.from_arrays([pa.array(names[y[part]]), pa.array(visits), batch.column("codes").take(pa.array(x[part]))], ["block", "visits", "codes"])

    return routes


def _search(max_bits: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, its own segments before those that visit it."""
        name, parts, own, root = None, [], None, None

        def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            """The block is whole: its codes' tree, and what links them among themselves."""
            nonlocal own, root, parts
            if not parts:
                return
            own, parts = Tree(np.concatenate(parts)), []
            root, held = np.arange(len(own.codes)), []

            def merge() -> None:
                nonlocal root, held
                root = _roots(len(root), np.concatenate([np.arange(len(root)), *(i for i, _ in held)]), np.concatenate([root, *(j for _, j in held)]))
                held = []

            for found in near_pairs(own, own, max_bits):
                held.append(found)
                if sum(len(i) for i, _ in held) > len(root) + FRONTIER or len(held) > FRONTIER:
                    merge()
            merge()
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield links(own.codes[root[tied]], own.codes[tied])

        def visit(segment: np.ndarray) -> pa.RecordBatch:
            """Of a visitor's links into one group of the block, one is enough."""
            ties = [np.unique(np.stack([i, root[j]], axis=1), axis=0) for i, j in near_pairs(Tree(segment), own, max_bits) if len(i)]
            tie = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *ties]), axis=0)
            return links(segment[tie[:, 0]], own.codes[tie[:, 1]])

        for batch in batches:
            for block, visits, codes in zip(batch.column("block").to_pylist(), batch.column("visits").to_pylist(), batch.column("codes")):
                if block != name:
                    yield from close()
                    name, own = block, None
                segment = np.frombuffer(codes.as_buffer(), np.uint64)
                if not visits:
                    parts.append(segment)
                    continue
                yield from close()
                yield visit(segment)
        yield from close()

    return search


def near_fingerprints(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all fingerprints of codes (fp long, distinct) with at most max_bits different bits.

    Codes are put in Gray order by range partitions and cut into blocks of neighbours.
    The blocks' shared patterns, at most BLOCKS of them, are the top of the index and go
    to every task; a segment of codes is sent to the blocks that these do not prune, and
    each block searches its own tree for its codes and its visitors.  Of the pairs found
    a spanning forest is returned, which keeps every component and not all pairs.
    Blocks hold equal shares of the codes, so a dense group of near copies is spread over
    as many blocks as its codes fill.
    """
    n = codes.count()
    bits = min(max((n >> 6).bit_length(), BLOCK_BITS[0]), BLOCK_BITS[1])
    block = max(1 << bits, -(-n // (BLOCKS * SEGMENT)) * SEGMENT)
    in_order = codes.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(max(1, n // block), "rank").sortWithinPartitions("rank")
    segments = written(in_order.select("fp").mapInArrow(_segments(block), "block long, every long, some long, codes binary"), "segments")
    tops = segments.groupBy("block").agg(F.bit_and("every").alias("every"), F.bit_or("some").alias("some")).orderBy(gray_rank(F.col("block"))).collect()
    names, every, some = (np.array([r[k] for r in tops], np.int64) for k in range(3))
    sent = segments.mapInArrow(_routes(names, every.view(np.uint64), some.view(np.uint64), max_bits), "block long, visits boolean, codes binary")
    return sent.repartition("block").sortWithinPartitions("block", "visits").mapInArrow(_search(max_bits), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp long, component_id long) for every row of docs.

    component_id is the smallest id reachable over links, an id's own included.  Equal
    fingerprints are one node, whatever their number.  Texts without words have
    fingerprint 0 and link like any other.  Rows with a null id get the component of
    their fingerprint (null where no row of the component has an id).  Repeated rows
    stay, each with the same answer.  An empty table gives no rows; other columns of
    docs are neither read nor returned.
    """
    return _components(docs, id_col, text_col, max_bits, F.col("doc_id")).select("doc_id", "fp", F.col("least").alias("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, max_bits: int, ranked: Column, hashed: bool = False) -> DataFrame:
    """fingerprints() of docs with least: the smallest value of ranked in the row's component."""
    prints = written(fingerprints(docs, id_col, text_col, hashed), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(ranked).alias("id")), "codes")
    groups = written(connected_components(near_fingerprints(nodes.select("fp"), max_bits)), "components")
    named = groups.join(nodes, groups["node"] == nodes["fp"]).groupBy("component").agg(F.min("id").alias("least"))
    named = written(named, "least")  # so that a large component's rows can be split among tasks in the join
    of_code = nodes.join(groups, nodes["fp"] == groups["node"], "left").join(named, "component", "left")
    labels = written(of_code.select("fp", F.coalesce("least", "id").alias("least")), "labels")
    return prints.join(labels, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, that of the smallest id; columns as in docs.

    Rows are told apart by id and hash of the text, so that an id with several texts is
    judged text by text; of a group's texts under its smallest id the one of the
    smallest hash stays.  Only the (id, hash) that go are joined to the texts, as an
    anti-join.  Equal rows (id and text) count as one and one of them stays; a row
    without an id stays, as nothing tells it from others.  An empty table stays empty.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))
    thin = written(_components(docs, id_col, text_col, MAX_BITS, row, hashed=True).where("doc_id is not null"), "groups")
    first = F.struct("doc_id", "hash") == F.col("least")

    def matched(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return rows.join(some, (rows[id_col] == some["doc_id"]) & (F.xxhash64(rows[text_col]) == some["hash"]), how)

    gone = written(thin.where(~first).select("doc_id", "hash").distinct(), "gone")
    rest = matched(docs, gone, "left_anti")
    again = written(thin.where(first).groupBy("doc_id", "hash").count().where("count > 1").select("doc_id", "hash"), "repeated")
    if again.isEmpty():
        return rest
    once = matched(rest, again, "left_semi").dropDuplicates([id_col, text_col])
    return matched(rest, again, "left_anti").unionByName(once)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
