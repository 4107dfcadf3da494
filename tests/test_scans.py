"""Block scans against plain loops, with blocks far smaller than the data."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tracemill.functions.ordering import first_rows, islands, neighbour, ordinal, sorted_place
from tracemill.operators import timing
from tracemill.operators.pairing import fifo_pairs, pair_events, write_back


def rows(seed, n=400, keys="ab"):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, rng.randint(0, 2)) for i in range(n)]


def per_key(data):
    out = {}
    for key, order, value in data:
        out.setdefault(key, []).append((order, value))
    return out


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_neighbour_and_ordinal(spark, block):
    data = rows(1)
    df = spark.createDataFrame(data, "k string, n bigint, v bigint")
    got = {(r.k, r.n): (r.p.v if r.p else None, r.f.v if r.f else None, r.o) for r in ordinal(
        neighbour(neighbour(df, ["k"], "n", ["v"], "p", block_rows=block), ["k"], "n", ["v"], "f", following=True, block_rows=block),
        ["k"], "n", "o", block).collect()}
    for key, items in per_key(data).items():
        for i, (order, _) in enumerate(items):
            before = items[i - 1][1] if i else None
            after = items[i + 1][1] if i + 1 < len(items) else None
            assert got[key, order] == (before, after, i + 1)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_islands(spark, block):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, n bigint, v bigint")
    same = lambda p, c: p["v"] == c["v"]
    got = {(r.k, r.n): r.i for r in islands(df, ["k"], "n", ["v"], same, "i", block).collect()}
    for key, items in per_key(data).items():
        number, last = 0, None
        for order, value in items:
            number += value != last
            last = value
            assert got[key, order] == number


@pytest.mark.parametrize("limit", [0, 5, 1500])
def test_first_rows(spark, limit):
    data = [("a", i * 2, 0) for i in range(3000)] + [("b", 1, 0)]
    df = spark.createDataFrame(data, "k string, n bigint, v bigint")
    got = sorted((r.k, r.n) for r in first_rows(df, ["k"], "n", limit, 64).collect())
    a = [("a", i * 2) for i in range(3000)]
    assert got == (a if limit == 0 else a[:limit]) + [("b", 1)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [3, 1000])
def test_fifo_pairs(spark, seed, block):
    rng = random.Random(seed)
    data = [(rng.choice("xy"), i, rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(data, "k string, n bigint, asks boolean")
    want, queues = set(), {}
    for key, order, asks in data:
        queue = queues.setdefault(key, deque())
        if asks:
            queue.append(order)
        elif queue:
            want.add((key, queue.popleft(), order))
    got = {(r.k, r.request, r.response) for r in fifo_pairs(df, ["k"], "n", "asks", block).collect()}
    assert got == want


def loop_bursts(times, gap, size):
    found, run = [], times[:1]
    for before, now in zip(times, times[1:]):
        if 0 <= now - before <= gap:
            run.append(now)
        else:
            found.append(run)
            run = [now]
    return [(r[0], r[-1], len(r)) for r in [*found, run] if len(r) >= size]


@pytest.mark.parametrize("block", [5, 10000])
def test_bursts_and_gap_stats(spark, block):
    rng = random.Random(5)
    times, now = [], 0.0
    for _ in range(500):
        now += rng.choice([10.0, 20.5, 999.0, 1000.0, 1000.5, 4000.0, -5.0])
        times.append(round(now, 3))
    data = [("c", i, t) for i, t in enumerate(times)] + [("c", 900, None), ("one", 1, 5.0)]
    df = spark.createDataFrame(data, "capture_id string, frame_no bigint, time_rel_ms double")
    got = sorted((r.start_ms, r.end_ms, r.packet_count) for r in timing.bursts(df, ["capture_id"], block_rows=block).collect())
    assert got == sorted(loop_bursts(times, 1000, 5))
    gaps = sorted(b - a for a, b in zip(times, times[1:]))
    (row,) = timing.gap_stats(df, ["capture_id"], block_rows=block).collect()
    assert row.capture_id == "c" and row.packet_count == 500
    assert row.gap_p95 == pytest.approx(round(gaps[int((len(gaps) - 1) * 0.95)], 3))
    assert row.gap_min == pytest.approx(gaps[0], abs=1e-3) and row.gap_max == pytest.approx(gaps[-1], abs=1e-3)
    assert row.gap_mean == pytest.approx(sum(gaps) / len(gaps), abs=1e-3)


def test_unordered_times_keep_export_order(spark):
    data = [("c", i, t) for i, t in enumerate([0.0, 100.0, 50.0, 150.0])]
    df = spark.createDataFrame(data, "capture_id string, frame_no bigint, time_rel_ms double")
    (row,) = timing.gap_stats(df, ["capture_id"]).collect()
    assert (row.gap_min, row.gap_max, row.gap_mean, row.gap_p95, row.duration_ms) == (-50.0, 100.0, 50.0, 100.0, 150.0)
    assert timing.bursts(df, ["capture_id"], min_size=2).count() == 2


def test_sorted_place(spark):
    rng = random.Random(9)
    data = [(rng.choice("ab"), f"x{rng.randint(0, 50):02d}", i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, label string, id int").repartition(7)
    got = {(r.k, r.id): r.p for r in sorted_place(df, ["k"], ["label", "id"], "p").collect()}
    for key in "ab":
        wanted = sorted((label, i) for k, label, i in data if k == key)
        assert all(got[key, i] == place for place, (_, i) in enumerate(wanted))


@pytest.mark.parametrize("seed", range(3))
def test_pairing_in_event_order(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(250):
        asks = rng.random() < 0.5
        ends = ("a", "b") if asks else ("b", "a")
        data.append(("c", i, "p", rng.choice([None, "id:1", "id:2", "id:3"]), "Go " + ("Request" if asks else "Response"), "request" if asks else "response", *ends, asks, not asks))
    # a response without its id takes request 900 by name, the late one takes it by id as well
    late = [(900, "id:9", True), (901, "id:8", False), (902, "id:9", False), (903, None, False)]
    data += [("d", i, "p", c, "Go", "request" if q else "response", *(("a", "b") if q else ("b", "a")), q, not q) for i, c, q in late]
    names = "capture_id string, event_no bigint, protocol string, correlation_id string, message_name string, status string, src_node string, dst_node string, is_request boolean, is_response boolean"
    events = spark.createDataFrame(data, names)
    queues, want, linked = {}, set(), {}
    for capture, i, _, corr, _, _, _, _, asks, _ in data:
        own, shared = queues.setdefault((capture, corr or "go"), deque()), queues.setdefault((capture, "go"), deque())
        if asks:
            own.append(i)
            if own is not shared:
                shared.append(i)
            continue
        queue = own or shared
        if queue:
            found = queue.popleft()
            want.add((capture, found, i, "strict" if queue is own and corr else "loose"))
            linked[capture, i], linked[capture, found] = found, i
    pairs = pair_events(events, 7, order="events")
    assert {tuple(r) for r in pairs.select("capture_id", "request", "response", "by").collect()} == want
    got = {(r.capture_id, r.event_no): r.paired_event_id for r in write_back(events, pairs).collect()}
    assert got == {(r[0], r[1]): f"event-{linked[r[0], r[1]]}" if (r[0], r[1]) in linked else None for r in data}
    assert {("d", 900, 901, "loose"), ("d", 900, 902, "strict")} <= want
    assert {(r.request, r.response) for r in pair_events(events.where("capture_id = 'd'")).collect()} == {(900, 902)}


def test_unknown_pairing_order(spark):
    with pytest.raises(ValueError):
        pair_events(spark.createDataFrame([], "capture_id string"), order="time")
