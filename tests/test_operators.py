from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import catalog, folds, history, ranges, reads, state, ttl
from keyloom.sources import logs, sorted_tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_log(seed, n=300):
    r = random.Random(seed)
    return [(r.randrange(20), f"v{k}", r.choice(["put", "put", "delete"]), 1, k // 5, k % 5) for k in range(n)]


LOG = "key long, value string, op string, term long, idx long, ordinal int"


def model(rows):
    live = {}
    for key, value, op, *_ in rows:
        live.pop(key, None)
        if op == "put":
            live[key] = value
    return live


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_sequential_model(spark, seed):
    rows = random_log(seed)
    shuffled = random.Random(9).sample(rows, len(rows))
    got = state.fold(frame(spark, shuffled, LOG), ["term", "idx", "ordinal"]).collect()
    assert {r.key: r.value for r in got} == model(rows)


def test_fold_control_sees_a_changed_order(spark):
    rows = [(1, "a", "put", 1, 1, 0), (1, "b", "put", 1, 2, 0)]
    swapped = [(1, "a", "put", 1, 2, 0), (1, "b", "put", 1, 1, 0)]
    value = lambda rs: state.fold(frame(spark, rs, LOG), ["term", "idx", "ordinal"]).first().value
    assert (value(rows), value(swapped)) == ("b", "a")


def test_batch_is_all_or_nothing(spark):
    log = frame(spark, [(1, "a", "b1"), (2, "b", "b1"), (3, "c", "b2")], "key long, value string, batch string")
    verdicts = frame(spark, [("b1", "StaleEpoch"), ("b2", "ok")], "batch string, verdict string")
    assert [r.key for r in state.accepted(log, verdicts, "batch").collect()] == [3]


def test_garbage_keeps_the_newest_unless_tombstone(spark):
    rows = [(1, 1, False), (1, 3, False), (1, 9, False), (2, 2, False), (2, 4, True), (3, 8, False)]
    marked = state.garbage(frame(spark, rows, "key long, version long, is_tombstone boolean"), 5)
    gone = {(r.key, r.version) for r in marked.where("doomed").collect()}
    assert gone == {(1, 1), (2, 2), (2, 4)}


def test_delete_range_is_chunked_and_not_reevaluated(spark):
    kv = frame(spark, [(k, "v") for k in range(10)], "key long, value string")
    plan = state.delete_range_plan(kv, 2, 9, chunk=3)
    assert sorted((r.key, r.chunk) for r in plan.collect()) == [(2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 1), (8, 2)]
    log = frame(spark, [(8, "later", "put", 15), (42, "new", "put", 15)], "key long, value string, op string, version long")
    positions = frame(spark, [(0, 10), (1, 12), (2, 20)], "chunk long, version long")
    live = state.fold(state.delete_chunk(log, plan, positions), ["version"]).collect()
    assert [r.key for r in live] == [42]


def test_overlay_hides_and_shows(spark):
    snap = frame(spark, [(1, "a"), (2, "b")], "key long, value string")
    over = frame(spark, [(1, "delete", None), (3, "put", "c"), (2, "put", None)], "key long, op string, value string")
    assert sorted((r.key, r.value) for r in state.overlay(snap, over).collect()) == [(2, None), (3, "c")]


def page_model(rows, start, end, wm, n, examined, size):
    """(rows, examined, cursor, inclusive): one row after another, the cursor None at the range's end."""
    out, seen, used, last = [], 0, 0, None
    inside = iter([r for r in rows if r[0] >= start and (end is None or r[0] < end)])
    while seen < examined and len(out) < n:
        row = next(inside, None)
        if row is None:
            return out, seen, None, None
        key, value, exp = row
        seen, last = seen + 1, key
        if exp is None or exp > wm:
            cost = len(str(key)) + len(value) + 16
            if used + cost > size:
                return out, seen, key, True
            out.append((key, value))
            used += cost
    return out, seen, last, False


@pytest.mark.parametrize("seed", range(6))
def test_ttl_page_equals_model(spark, seed):
    r = random.Random(seed)
    rows = [(k, "v" * r.randrange(1, 9), r.choice([None, 5, 50])) for k in sorted(r.sample(range(200), 60))]
    kv = frame(spark, rows, "key long, value string, expires_at_ms long")
    args = (20, 150, 10, r.randrange(1, 20), r.randrange(1, 40), r.randrange(40, 400)) if seed < 4 else (20, 60, 10, 50, 50, 4000)
    got = ttl.scan_page(kv, *args).orderBy("key").collect()
    cur = ttl.scan_cursor(kv, *args).first()
    want, seen, last, inclusive = page_model(rows, *args)
    assert [tuple(x) for x in got] == want
    assert (cur.n_rows, cur.n_examined, cur.resume_key, cur.resume_inclusive) == (len(want), seen, last, inclusive)


def test_pages_join_to_the_whole_range(spark):
    """Binary keys of different lengths, read page by page until there is no cursor."""
    keys = [bytes([a]) + b"\x00" * b for a in (1, 2, 255) for b in range(4)]
    kv = frame(spark, [(k, "v", 1 if n % 3 == 0 else None) for n, k in enumerate(keys)], "key binary, value string, expires_at_ms long")
    at, read, turns = b"", [], 0
    while at is not None:
        read += [bytes(r.key) for r in ttl.scan_page(kv, at, b"\xff\x00\x00", 10, 2, 3, 60).orderBy("key").collect()]
        cur = ttl.scan_cursor(kv, at, b"\xff\x00\x00", 10, 2, 3, 60).first()
        at = None if cur.resume_key is None else bytes(cur.resume_key) + (b"" if cur.resume_inclusive else b"\x00")
        turns += 1
    assert read == [k for n, k in enumerate(keys) if n % 3 and k < b"\xff\x00\x00"] and turns >= 4


def test_budgets_must_be_positive(spark):
    kv = frame(spark, [(1, "v", 1)], "key long, value string, expires_at_ms long")
    for page in (lambda: ttl.scan_page(kv, 0, None, 10, 0, 3, 100), lambda: ttl.cleanup_page(kv, 0, None, 10, 3, 0, 100), lambda: ttl.delete_page(kv, 0, None, 3, 0)):
        with pytest.raises(ValueError):
            page()


def test_cleanup_needs_the_same_record(spark):
    schema = "key long, value string, expires_at_ms long, expiry_term long, expiry_idx long"
    kv = frame(spark, [(1, "a", 5, 1, 1), (2, "b", 5, 1, 9), (3, "c", 50, 1, 3)], schema)
    seen = frame(spark, [(1, "", 5, 1, 1), (2, "", 5, 1, 2), (3, "", 50, 1, 3)], schema)
    assert sorted(r.key for r in ttl.cleanup_apply(kv, seen, 10).collect()) == [2, 3]


def test_all_expired_page_has_a_cursor(spark):
    kv = frame(spark, [(k, "v", 1) for k in range(5)], "key long, value string, expires_at_ms long")
    cur = ttl.scan_cursor(kv, 0, None, 10, 3, 3, 100).first()
    assert (cur.n_rows, cur.resume_key, cur.resume_inclusive) == (0, 2, False)


def test_oversized_row_is_an_error(spark):
    kv = frame(spark, [(1, "v" * 50, None)], "key long, value string, expires_at_ms long")
    with pytest.raises(Exception, match="byte budget"):
        ttl.scan_page(kv, 0, None, 10, 3, 3, 20).collect()


def test_deadline_at_watermark_is_hidden(spark):
    df = spark.createDataFrame([(None,), (10,), (11,)], "e long").select(ttl.visible(F.col("e"), 10).alias("v"))
    assert [r.v for r in df.collect()] == [True, False, True]


def test_expiry_overflow_refuses(spark):
    df = spark.createDataFrame([((1 << 62),)], "t long").select(ttl.resolve_expiry(F.col("t"), F.lit(1).cast("long")))
    with pytest.raises(Exception, match="OVERFLOW"):
        df.collect()


@pytest.mark.parametrize("most", [0, 1000])
def test_routes_agree(spark, most):
    r = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 20, None), (3, 2, 0, None)], "range_id long, keyspace_id long, start long, end long")
    keys = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 20), (2, 10), (3, 1)], "keyspace_id long, key long")
    got = {(x.keyspace_id, x.key): x.range_id for x in ranges.route(keys, r, most).collect()}
    assert got == {(1, 0): 1, (1, 9): 1, (1, 10): None, (1, 20): 2, (2, 10): 3, (3, 1): None}


@pytest.mark.parametrize("most", [0, 1000])
def test_overlapping_ranges_have_one_owner(spark, most):
    r = spark.createDataFrame([(1, 1, b"", b"z"), (2, 1, b"b", b"d"), (3, 1, b"b", b"c"), (4, 2, b"q", None)], "range_id long, keyspace_id long, start binary, end binary")
    keys = spark.createDataFrame([(1, k) for k in (b"", b"a", b"b", b"c", b"d", b"y")] + [(2, b"a"), (2, b"q\x00")], "keyspace_id long, key binary")
    got = {(x.keyspace_id, bytes(x.key)): x.range_id for x in ranges.route(keys, r, most).collect()}
    assert got == {(1, b""): 1, (1, b"a"): 1, (1, b"b"): 3, (1, b"c"): None, (1, b"d"): None, (1, b"y"): None, (2, b"a"): None, (2, b"q\x00"): 4}


def test_overlaps_are_all_found(spark):
    rows = [(1, 0, 9), (2, 1, 4), (3, 3, None), (4, 9, 9), (5, 4, 6)]
    df = spark.createDataFrame([(1, *r) for r in rows], "keyspace_id long, range_id long, start long, end long")
    assert sorted((r.left, r.right) for r in ranges.overlaps(df).collect()) == [(1, 2), (1, 3), (1, 5), (2, 3), (3, 5)]


def _shuffled(spark) -> dict:
    """Records that each stage so far has written to a shuffle."""
    core = spark.sparkContext._jsc.sc()
    core.listenerBus().waitUntilEmpty(30_000)
    stages = core.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(k) for k in range(stages.size()))}


def test_overlaps_over_several_blocks_shuffle_ranges_and_not_pairs(spark):
    r = random.Random(8)
    rows = [(r.randrange(2), k, at := r.randrange(900), None if k % 5 == 0 else at + r.randrange(1500)) for k in range(3000)]
    df = spark.createDataFrame(rows, "keyspace_id long, range_id long, start long, end long")
    before = _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ranges were many
    try:
        pairs = ranges.overlaps(df).select("keyspace_id", "left", "right").toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = sum(n for stage, n in _shuffled(spark).items() if stage not in before)
    want = []
    for space in range(2):
        own = sorted((lo, k, hi) for s, k, lo, hi in rows if s == space and (hi is None or hi > lo))
        want += [(space, k, other) for at, (_, k, hi) in enumerate(own) for lo, other, _ in own[at + 1 :] if hi is None or lo < hi]
    assert sorted(pairs.itertuples(index=False, name=None)) == sorted(want)
    assert len(want) > 1_000_000
    assert shuffled < 20 * len(rows)


def test_places_and_sums_over_many_parts(spark):
    from keyloom.operators import ordering

    r = random.Random(4)
    rows = [(bytes(r.randrange(256) for _ in range(r.randrange(1, 6))) + k.to_bytes(2, "big"), r.randrange(9)) for k in range(500)]
    df = frame(spark, rows, "key binary, bytes long").repartition(7)
    rows.sort()
    assert {bytes(x.key): x.place for x in ordering.placed(df, ["key"]).collect()} == {k: n for n, (k, _) in enumerate(rows)}
    total, want = 0, {}
    for k, n in rows:
        total += n
        want[k] = total
    assert {bytes(x.key): x.upto for x in ordering.running(df, ["key"], "bytes").collect()} == want
    assert ordering.placed(df.limit(0), ["key"]).count() == 0


@pytest.mark.parametrize("rows, valid", [([(0, 5), (5, None)], True), ([(0, 5), (6, None)], False), ([(0, 6), (5, None)], False), ([(0, 5), (5, 9)], False), ([(1, None)], False)])
def test_partition_validity(spark, rows, valid):
    df = spark.createDataFrame([(1, k, s, e, False) for k, (s, e) in enumerate(rows)], "keyspace_id long, range_id long, start long, end long, sealed boolean")
    assert ranges.partition_check(df, first=0).first().valid == valid


def test_digest_sees_one_changed_value(spark):
    rows = [(k, f"v{k}") for k in range(2000)]
    kv = frame(spark, rows, "key long, value string").withColumn("r", F.lit(1))
    same = reads.range_digest(kv.repartition(7), ["r"]).first().digest
    assert same == reads.range_digest(kv, ["r"]).first().digest
    other = kv.withColumn("value", F.when(F.col("key") == 7, "x").otherwise(F.col("value")))
    assert reads.range_digest(other, ["r"]).first().digest != same


def test_catalog_checks(spark):
    there = frame(spark, [(1, "a", 10)], "id long, name string, parent long")
    rows = frame(spark, [(1, "b", 10), (2, "c", 10), (2, "d", 10), (3, "e", 99), (4, "a", 10), (5, "f", None), (6, None, 10), (7, None, 10)], "id long, name string, parent long")
    parents = frame(spark, [(10,)], "pid long")
    got = catalog.insert(there, rows, ["id"], ["name"], "parent", parents, "pid").collect()
    assert sorted((r.id, r.verdict) for r in got) == [(1, "WriteConflict"), (2, "WriteConflict"), (2, "WriteConflict"), (3, "ForeignKey"), (4, "Unique"), (5, "ok"), (6, "ok"), (7, "ok")]
    kept = catalog.delete(rows, rows, ["id"], frame(spark, [(4,)], "of long"), "of").collect()
    assert [r.id for r in kept] == [4]
    changed = catalog.update(there, frame(spark, [(1, None), (9, "z")], "id long, name string"), ["id"]).collect()
    assert [tuple(r) for r in changed] == [(1, None, 10)]


def test_batch_limits(spark):
    kv = frame(spark, [(1, "a")], "key long, value string")
    with pytest.raises(ValueError):
        reads.batch_get(kv, list(range(300)))
    with pytest.raises(ValueError):
        reads.scan(kv, limit=0)
    assert reads.batch_get_within(kv, [1, 1, 1], 2).count() == 0


def test_token_bucket_model(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), r.randrange(10_000_000), k, r.randrange(1, 6)) for k in range(200)]
    got = folds.token_bucket(frame(spark, rows, "tenant long, ts_us long, request_id long, cost long"), 10, 2).collect()
    want = {}
    for tenant in range(3):
        tokens, last = 10_000_000, None
        for _, ts, rid, cost in sorted(x for x in rows if x[0] == tenant):
            tokens = min(10_000_000, tokens + (0 if last is None else ts - last) * 2)
            last = ts
            ok = tokens >= cost * 1_000_000
            tokens -= cost * 1_000_000 * ok
            want[rid] = (ok, tokens)
    assert {x.request_id: (x.admitted, x.tokens) for x in got} == want


def test_admission_order_of_checks(spark):
    rows = [(1, 1, "request", 10, False), (1, 2, "request", 10, False), (1, 3, "request", 10, True), (1, 4, "request", 999, False), (1, 5, "release", 10, False), (1, 6, "request", 95, False)]
    got = folds.admission(frame(spark, rows, "server long, seq long, kind string, bytes long, metadata boolean"), 3, 100, 1).orderBy("seq").collect()
    assert [r.verdict for r in got] == ["admitted", "admitted", "admitted", "too_large", "released", "metadata_floor"]


def test_manifest_swaps(spark):
    rows = [(1, 10, 0, "a", 5, True), (1, 11, 0, "a", 5, True), (1, 12, 0, "b", 5, True), (1, 13, 1, "", 5, True), (1, 14, 1, "c", 14, True), (1, 15, 1, "c", 5, False), (1, 16, 1, "c", 5, True)]
    got = folds.manifest_swaps(frame(spark, rows, "range_id long, seq long, expected long, change_id string, watermark long, in_scope boolean")).orderBy("seq").collect()
    assert [r.verdict for r in got] == ["applied", "already_applied", "stale", "invalid", "invalid", "invalid", "applied"]


def test_pins_move_one_phase_at_a_time(spark):
    rows = [(1, 1, k, p) for k, p in enumerate(["Published", "Held", "Published", "Released", "Quiesced", "Released", "Held"])]
    got = folds.pin_transitions(frame(spark, rows, "resource long, owner long, seq long, phase string")).orderBy("seq").collect()
    assert [r.accepted for r in got] == [False, True, True, False, True, True, False]


def test_fnv_vectors():
    assert folds.fnv1a(b"") == 0xCBF29CE484222325 and folds.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_checksums_are_per_page_of_rows(spark):
    rows = sorted((bytes([k % 251, k // 251, k % 7]), f"v{k}".encode()) for k in range(1000))
    kv = frame(spark, rows, "key binary, value binary")
    got = {r.page: (r.n, r.checksum) for r in folds.range_checksums(kv.repartition(5)).collect()}
    assert got == {p: (len(part), f"{folds.fnv1a(b''.join(k + v for k, v in part)):016x}") for p in (0, 1) for part in [rows[512 * p : 512 * p + 512]]}


@pytest.mark.parametrize("ops, verdict", [
    ([(1, 2, "put", "a", "ok", None), (3, 4, "get", None, "ok", "a")], "valid"),
    ([(1, 2, "put", "a", "ok", None), (3, 4, "get", None, "ok", None)], "invalid"),
    ([(1, None, "put", "a", "unknown", None), (3, 4, "get", None, "ok", None), (5, 6, "get", None, "ok", "a")], "valid"),
    ([(1, None, "put", "a", "unknown", None), (3, 4, "get", None, "ok", "a"), (5, 6, "get", None, "ok", None)], "invalid"),
    ([(1, 2, "put", "a", "refused", None), (3, 4, "get", None, "ok", "a")], "invalid"),
    ([(1, 6, "put", "a", "ok", None), (2, 3, "get", None, "ok", "a"), (4, 5, "get", None, "ok", None)], "invalid"),
])
def test_history_verdicts(ops, verdict):
    assert history.explain(ops) == verdict


def test_history_search_against_permutations():
    from itertools import permutations

    r = random.Random(5)
    for _ in range(60):
        ops, t = [], 0
        for _ in range(4):
            a = t + r.randrange(3)
            b = a + 1 + r.randrange(6)
            t = a + 1
            op = r.choice(["put", "get", "delete"])
            ops.append((2 * a, 2 * b + 1, op, r.choice("xy") if op == "put" else None, "ok", r.choice(["x", "y", None]) if op == "get" else None))
        def fits(order):
            value = None
            for k, o in enumerate(order):
                if any(p[1] < o[0] for p in order[k + 1 :]):
                    return False
                if o[2] == "get" and o[5] != value:
                    return False
                value = o[3] if o[2] == "put" else None if o[2] == "delete" else value
            return True
        assert (history.explain(ops) == "valid") == any(fits(p) for p in permutations(ops))
        order = history.witness(ops)
        assert (order is not None) == (history.explain(ops) == "valid") and (order is None or (history.replayed(ops, order) and fits([ops[k] for k in order])))


def random_history(r, n):
    ops, t, value = [], 0, None
    for _ in range(n):
        a, b = t, t + 1 + r.randrange(4)
        t = t + 1 if r.random() < 0.6 else b + 1
        op = r.choice(["put", "get", "get", "delete"])
        outcome = r.choices(["ok", "unknown", "refused"], [12, 1, 1])[0]
        written = r.choice("xyz") if op == "put" else None
        result = (value if r.random() < 0.85 else r.choice(["x", None])) if op == "get" and outcome == "ok" else None
        ops.append((2 * a, 2 * b + 1 if outcome != "unknown" else None, op, written, outcome, result))
        if op != "get" and outcome == "ok":
            value = written
    return ops


def test_pieces_give_what_the_whole_gives(spark):
    r = random.Random(8)
    rows, want = [], {}
    for h in range(60):
        verdicts = []
        for key in "ab":
            ops = random_history(r, 9)
            rows += [(h, key, i, e, op, v, out, res) for i, e, op, v, out, res in ops]
            verdicts.append(history.explain(ops))
        want[h] = "invalid" if "invalid" in verdicts else "valid"
    ops = frame(spark, rows, "history long, key string, invoked long, returned long, op string, value string, outcome string, result string")
    assert {x.history: x.verdict for x in history.check_histories(ops).collect()} == want
    assert 10 < sum(v == "valid" for v in want.values()) < 50
    assert history.pieces(ops).agg(F.max("piece").alias("n")).first().n >= 2


def test_a_changed_witness_is_refused():
    ops = [(1, 2, "put", "a", "ok", None), (3, 4, "put", "b", "ok", None), (5, 6, "get", None, "ok", "b")]
    assert history.replayed(ops, [0, 1, 2])
    assert not any(history.replayed(ops, o) for o in ([1, 0, 2], [0, 1], [0, 2, 1], [0, 1, 2, 2]))


def test_a_plain_log_refuses_options(spark, tmp_path):
    log = frame(spark, [], logs.LOG)
    for option in ({"ttl_secs": 0}, {"causal_ts": 5}):
        with pytest.raises(NotImplementedError):
            logs.append(log, f"file://{tmp_path}/log", **option)


def test_malformed_history(spark):
    rows = [("h", 1, "invoke", 1), ("h", 1, "return", 1), ("h", 3, "return", 2), ("h", 4, "invoke", 3), ("h", 5, "invoke", 3)]
    got = history.malformed(frame(spark, rows, "history string, seq long, type string, id long")).collect()
    assert {r.problem for r in got} == {"repeated seq", "repeated invoke", "return without invoke"}


def test_shortest_invalid_prefix(spark):
    rows = [("h", "x", 1, 2, "put", "a", "ok", None), ("h", "x", 3, 4, "get", None, "ok", "b"), ("h", "x", 5, 6, "get", None, "ok", "a")]
    ops = frame(spark, rows, "history string, key string, invoked long, returned long, op string, value string, outcome string, result string")
    assert history.shortest_invalid(ops).first().prefix == 2


def test_sorted_tables_round_trip(spark, tmp_path):
    kv = frame(spark, [(k, f"v{k}") for k in range(500)], "key long, value string")
    path = f"file://{tmp_path}/t"
    sorted_tables.write_sorted(kv, path, ["key"], rows_per_file=100)
    m = sorted_tables.manifest(spark, path, "key")
    rows = sorted(m.collect(), key=lambda r: r.smallest)
    assert sum(r.n for r in rows) == 500 and all(a.largest < b.smallest for a, b in zip(rows, rows[1:]))
    probe = frame(spark, [(123,)], "probe long")
    assert sorted_tables.prune(m, probe).count() == 1
    assert sorted_tables.restore(spark, m, kv.schema).count() == 500
    objects = sorted_tables.object_digests(spark, path + "/*.parquet")
    assert sorted_tables.closure_problems(objects, objects).count() == 0
    with pytest.raises(ValueError):
        sorted_tables.write_sorted(kv.union(kv), f"file://{tmp_path}/u", ["key"])


def test_history_reader_fails_on_a_bad_line(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"history":"h","type":"invoke","seq":1,"id":1}\nnot json\n')
    with pytest.raises(Exception):
        logs.history(spark, f"file://{tmp_path}/h.json").collect()
