"""Operation histories: form, and whether some order of the operations explains them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators.folds import ordered_fold

STATES = 200_000  # places a search looks at before it gives up


def operations(events: DataFrame) -> DataFrame:
    """(history, id, key, op, value, invoked, returned, outcome, result) from events.

    events: history, seq, type (invoke or return), id, key, op, value, outcome, result.  An
    operation that never returned has outcome unknown and no end.
    """
    begun = events.where("type = 'invoke'").select("history", "id", "key", "op", "value", F.col("seq").alias("invoked"))
    ended = events.where("type = 'return'").select("history", "id", F.col("seq").alias("returned"), "outcome", "result")
    return begun.join(ended, ["history", "id"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("unknown")))


def malformed(events: DataFrame) -> DataFrame:
    """(history, problem, n): repeated seq, repeated invoke or return, return without or before invoke."""
    twice = events.groupBy("history", "seq").count().where("count > 1").select("history", F.lit("repeated seq").alias("problem"))
    again = events.groupBy("history", "type", "id").count().where("count > 1").select("history", F.concat(F.lit("repeated "), F.col("type")).alias("problem"))
    begun = events.where("type = 'invoke'").groupBy("history", "id").agg(F.min("seq").alias("begun"))
    ended = events.where("type = 'return'").select("history", "id", "seq")
    orphan = ended.join(begun, ["history", "id"], "left").where("begun is null or begun >= seq").select("history", F.lit("return without invoke").alias("problem"))
    return twice.unionByName(again).unionByName(orphan).groupBy("history", "problem").agg(F.count(F.lit(1)).alias("n"))


def apply_model(state, op: str, value):
    """(next state, what a read returns) of a single key."""
    if op == "get":
        return state, state
    return (value if op == "put" else None), None


START = ("start",)  # a piece's state before any of its writes


def outcomes(ops: list[tuple], most: int = STATES) -> dict[tuple, list[int]] | None:
    """What a piece of one key's history can do: (value it needs at its start, value at its end) -> an order of its operations.

    ops: (invoked, returned, op, value, outcome, result).  The need is (START,) where no
    read shows the start's value, the end START where nothing was written.  The order
    (places in ops) is a witness.  Depth first over sets of operations already placed: next comes any
    that was invoked before every open one returned.  A refused operation has no effect;
    one of unknown outcome may have it at any later time, or never.  None: given up.
    """
    use = [k for k, o in enumerate(ops) if o[4] != "refused" and not (o[4] == "unknown" and o[2] == "get")]
    ends = {k: float("inf") if ops[k][4] == "unknown" else ops[k][1] for k in use}
    must = frozenset(k for k in use if ops[k][4] == "ok")
    found: dict[tuple, list[int]] = {}
    seen, stack = set(), [(frozenset(), (START,), START, ())]
    while stack:
        done, need, state, order = stack.pop()
        if must <= done:
            found.setdefault((need, state), list(order))
        if (done, need, state) in seen:
            continue
        seen.add((done, need, state))
        if len(seen) > most:
            return None
        left = [k for k in use if k not in done]
        horizon = min((ends[k] for k in left), default=0)
        for k in left:
            invoked, _, op, value, _, result = ops[k]
            if invoked < horizon or ends[k] == horizon:
                if op != "get":
                    stack.append((done | {k}, need, value if op == "put" else None, (*order, k)))
                elif state != START:
                    if state == result:
                        stack.append((done | {k}, need, state, (*order, k)))
                elif need == (START,) or need == (result,):
                    stack.append((done | {k}, (result,), state, (*order, k)))
    return found


def follow(values: set, found: dict[tuple, list[int]]) -> set:
    """The values a key can have after a piece, from those it can have before."""
    return {v if end == START else end for need, end in found for v in values if need == (START,) or need == (v,)}


def explain(ops: list[tuple], most: int = STATES) -> str:
    """valid, invalid or inconclusive for one key's whole history, which begins without a value."""
    found = outcomes(ops, most)
    return "inconclusive" if found is None else "valid" if follow({None}, found) else "invalid"


def witness(ops: list[tuple], most: int = STATES) -> list[int] | None:
    """An order of the operations that explains a key's history, or None."""
    for (need, _), order in (outcomes(ops, most) or {}).items():
        if need in ((START,), (None,)):
            return order
    return None


def replayed(ops: list[tuple], order: list[int]) -> bool:
    """Whether an order explains a history, by going through it: every result fits, no operation
    comes before one that had returned when it began, and all that succeeded are there once."""
    value, latest = None, float("-inf")
    for k in order:
        invoked, returned, op, written, outcome, result = ops[k]
        if outcome == "refused" or (outcome == "ok" and returned < latest) or (op == "get" and outcome == "ok" and value != result):
            return False
        latest = max(latest, invoked)
        value, _ = apply_model(value, op, written)
    need = {k for k, o in enumerate(ops) if o[4] == "ok"}
    return len({*order}) == len(order) and need <= {*order}


def pieces(ops: DataFrame) -> DataFrame:
    """ops with piece: the number of moments before an operation when none of its key was open.

    Whatever comes before such a moment is placed before what comes after, so that pieces
    can be searched apart.  A write of unknown outcome stays open to the end.
    """
    by = Window.partitionBy("history", "key").orderBy("invoked")
    held = ops.where("outcome <> 'refused' and not (outcome = 'unknown' and op = 'get')")
    end = F.when(F.col("outcome") == "ok", F.col("returned")).otherwise(F.lit((1 << 63) - 1))
    open_to = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.col("invoked") > open_to, F.lit(False)).cast("int")
    return held.withColumn("cut", cut).withColumn("piece", F.sum("cut").over(by)).drop("cut")


def check_histories(ops: DataFrame, most: int = STATES) -> DataFrame:
    """(history, verdict): the worst of its keys, which are checked apart.

    Operations on one key each make a history linearizable if every key's part is.  A
    key's operations are cut where none is open; pieces are searched by many tasks, and
    what they need and leave, a short row each, is followed from one to the next.
    """

    names = ["history", "key", "piece", "known", "moves"]

    def searched(place: tuple, rows: list[tuple]) -> tuple:
        found = outcomes(rows, most)
        moves = [{"free": need == (START,), "need": None if need == (START,) else need[0], "same": end == START, "end": None if end == START else end} for need, end in found or {}]
        return (*place, found is not None, moves)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces come whole and in order; only one is held."""
        now, rows = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                place = (r.history, r.key, r.piece)
                if place != now:
                    if rows:
                        out.append(searched(now, rows))
                    now, rows = place, []
                rows.append((r.invoked, r.returned, r.op, r.value, r.outcome, r.result))
            yield pd.DataFrame(out, columns=names)
        if rows:
            yield pd.DataFrame([searched(now, rows)], columns=names)

    def chain(state, row):
        values, verdict = state
        if not row.known:
            verdict = "inconclusive" if verdict == "valid" else verdict
            return (None, verdict), (verdict,)
        if values is not None:
            values = {v if m["same"] else m["end"] for m in row.moves for v in values if m["free"] or m["need"] == v}
            verdict = verdict if values or verdict != "valid" else "invalid"
        elif not len(row.moves):
            verdict = "invalid"
        return (values, verdict), (verdict,)

    kinds = dict(ops.dtypes)
    value = "struct<free:boolean,need:string,same:boolean,end:string>"
    schema = f"history {kinds['history']}, key {kinds['key']}, piece long, known boolean, moves array<{value}>"
    cut = pieces(ops).withColumn("returned", F.coalesce("returned", "invoked"))  # of an open one nobody asks
    place = ["history", "key", "piece"]
    found = cut.repartition(*place).sortWithinPartitions(*place, "invoked").mapInPandas(search, schema)
    steps = ordered_fold(found, ["history", "key"], ["piece"], lambda row: ({None}, "valid"), chain, "verdict string")
    rank = F.when(F.col("verdict") == "invalid", 2).when(F.col("verdict") == "inconclusive", 1).otherwise(0)
    worst = steps.groupBy("history").agg(F.max(rank).alias("rank"))
    # histories of refused operations alone are valid
    all_ = ops.select("history").distinct().join(worst, "history", "left")
    return all_.select("history", F.when(F.col("rank") == 2, "invalid").when(F.col("rank") == 1, "inconclusive").otherwise("valid").alias("verdict"))


def shortest_invalid(ops: DataFrame, most: int = STATES) -> DataFrame:
    """(history, key, prefix): how many operations, by invocation, already cannot be explained."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.astype(object).where(pdf.notna(), None).sort_values("invoked")
        rows = [(r.invoked, r.returned, r.op, r.value, r.outcome, r.result) for r in pdf.itertuples()]
        low, high = 0, len(rows) + 1
        while high - low > 1:  # a longer prefix of an unexplained one stays unexplained
            mid = (low + high) // 2
            low, high = (low, mid) if explain(rows[:mid], most) == "invalid" else (mid, high)
        return pd.DataFrame({"history": [pdf["history"].iloc[0]], "key": [pdf["key"].iloc[0]], "prefix": [high if high <= len(rows) else None]})

    schema = f"history {dict(ops.dtypes)['history']}, key {dict(ops.dtypes)['key']}, prefix long"
    return ops.groupBy("history", "key").applyInPandas(one, schema).where("prefix is not null")


def in_flight(ops: DataFrame) -> DataFrame:
    """(history, most): the most operations open at once."""
    steps = ops.select("history", F.col("invoked").alias("at"), F.lit(1).alias("d")).union(ops.where("returned is not null").select("history", "returned", F.lit(-1)))
    open_ = steps.withColumn("open", F.sum("d").over(Window.partitionBy("history").orderBy("at")))
    return open_.groupBy("history").agg(F.max("open").alias("most"))
