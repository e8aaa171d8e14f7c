"""Order-dependent folds: token buckets, admission, manifest swaps, pins, checksums.

A fold's next state depends on refusals before it, so window sums cannot give it.  Each
key's rows are read in order by one task as a stream; what is held is the key's state and
one batch of rows, never a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.ordering import placed
from keyloom.operators.reads import encoded


def ordered_fold(df: DataFrame, by: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """A row for each row of df: by, order and what step(state, row) returns beside the next state."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = dict(df.dtypes)
    columns = [*by, *order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, c) for c in by)
                if key != now:
                    now, state = key, start(row)
                state, result = step(state, row)
                out.append((*key, *(getattr(row, c) for c in order), *result))
            yield pd.DataFrame(out, columns=[*columns, *names])

    dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), schema]))


def token_bucket(requests: DataFrame, capacity: int, per_second: int, every_us: int = 1) -> DataFrame:
    """(tenant, ts_us, request_id, admitted, tokens) for requests (tenant, ts_us, request_id, cost).

    A bucket starts full and refills with time up to its capacity, by per_second
    millionths of a token for every every_us microseconds that are over; a refused request
    takes nothing.  Tokens are counted in millionths, so that all is in whole numbers.
    """
    full = capacity * 1_000_000

    def start(row):
        return full, row.ts_us

    def step(state, row):
        tokens, last = state
        tokens = min(full, tokens + max(0, row.ts_us - last) * per_second // every_us)
        cost = row.cost * 1_000_000
        admitted = tokens >= cost
        tokens -= cost if admitted else 0
        return (tokens, max(last, row.ts_us)), (admitted, tokens)

    return ordered_fold(requests, ["tenant"], ["ts_us", "request_id"], start, step, "admitted boolean, tokens long")


def admit_unknown(requests: DataFrame, buckets: DataFrame) -> DataFrame:
    """requests with known: whether the tenant has a bucket; without one they are admitted."""
    return requests.join(buckets.select("tenant", F.lit(True).alias("known")), "tenant", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def admission(events: DataFrame, most: int = 64, most_bytes: int = 64 << 20, reserved: int = 8) -> DataFrame:
    """(server, seq, verdict, in_flight, bytes_held) for events (server, seq, kind, bytes, metadata).

    A request is checked for its own size, the count, the places reserved for metadata,
    the bytes; `release` gives back what an admitted request of so many bytes held.
    """

    def step(state, row):
        count, held = state
        if row.kind == "release":
            state = (max(0, count - 1), max(0, held - row.bytes))
            return state, ("released", *state)
        if row.bytes > most_bytes:
            verdict = "too_large"
        elif count >= most:
            verdict = "count"
        elif not row.metadata and count >= most - reserved:
            verdict = "metadata_floor"
        elif held + row.bytes > most_bytes:
            verdict = "bytes"
        else:
            verdict, state = "admitted", (count + 1, held + row.bytes)
        return state, (verdict, *state)

    return ordered_fold(events, ["server"], ["seq"], lambda row: (0, 0), step, "verdict string, in_flight long, bytes_held long")


def manifest_swaps(changes: DataFrame, last_generation: int = (1 << 63) - 1) -> DataFrame:
    """(range_id, seq, verdict, generation) of compare-and-swap attempts in order.

    changes: range_id, seq, expected, change_id, watermark, in_scope.
    """

    def step(state, row):
        generation, change = state
        if not row.in_scope or not row.change_id or row.watermark >= row.seq:
            verdict = "invalid"
        elif row.expected == generation:
            if generation >= last_generation:
                verdict = "invalid"
            else:
                verdict, generation, change = "applied", generation + 1, row.change_id
        elif row.expected + 1 == generation and row.change_id == change:
            verdict = "already_applied"
        else:
            verdict = "stale"
        return (generation, change), (verdict, generation)

    return ordered_fold(changes, ["range_id"], ["seq"], lambda row: (0, ""), step, "verdict string, generation long")


#: A pin's phases in the order in which it goes through them.
PHASES = ("Held", "Published", "Quiesced", "Released")


def pin_transitions(changes: DataFrame) -> DataFrame:
    """(resource, owner, seq, accepted, phase) of pin changes (resource, owner, seq, phase).

    A pin begins Held and moves on by one phase at a time; the same phase again is
    accepted and changes nothing.
    """

    def step(state, row):
        to = PHASES.index(row.phase) if row.phase in PHASES else -1
        ok = to >= 0 and (to == 0 if state is None else to in (state, state + 1))
        state = to if ok else state
        return state, (ok, None if state is None else PHASES[state])

    return ordered_fold(changes, ["resource", "owner"], ["seq"], lambda row: None, step, "accepted boolean, phase string")


FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, state: int = FNV_START) -> int:
    for b in data:
        state = ((state ^ b) * FNV_PRIME) & ((1 << 64) - 1)
    return state


def range_checksums(kv: DataFrame, page: int = 512) -> DataFrame:
    """(page, n, checksum): 64-bit FNV-1a over key and value bytes in key order, page by page.

    The hash runs through its input in order, so it is taken over pages of so many
    neighbouring rows, which any number of tasks work on.
    """
    kinds = dict(kv.dtypes)
    body = F.unhex(F.concat(encoded(F.col("key"), kinds["key"]), encoded(F.col("value"), kinds["value"])))
    rows = placed(kv.select("key", body.alias("body")), ["key"]).select(F.expr(f"place div {page}").alias("page"), "place", "body")

    def step(state, row):
        state = fnv1a(row.body, state)
        return state, (f"{state:016x}",)

    running = ordered_fold(rows, ["page"], ["place"], lambda row: FNV_START, step, "checksum string")
    return running.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.max_by("checksum", "place").alias("checksum"))
