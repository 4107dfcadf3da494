"""Windows, sessions and timeouts of a stream against their batch operators."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.operators import anomalies, stats, timing
from tracemill.streaming import windows

SCHEMA = """capture_id string, frame_no long, time_epoch string, top_protocol string, transport string, src_ip string, dst_ip string, time_rel_ms double,
diameter_flags string, diameter_cmd_code string, diameter_hop_by_hop_id string, diameter_result_code string, gtpv2_message_type string, gtpv2_seq_no string"""
END = 10_000_000


def row(frame, second, protocol="dns", capture="a", **more):
    base = {"capture_id": capture, "frame_no": frame, "time_epoch": None if second is None else f"{second:.6f}", "top_protocol": protocol}
    base |= {"src_ip": f"10.0.0.{frame % 3}", "time_rel_ms": None if second is None else second * 1000.0}
    return tuple((base | more).get(c.split()[0]) for c in SCHEMA.split(","))


def ask(frame, second, hop, flags="0xc0", **more):
    return row(frame, second, "diameter", diameter_flags=flags, diameter_cmd_code="316", diameter_hop_by_hop_id=hop, **more)


def answer(frame, second, hop, **more):
    return ask(frame, second, hop, "0x40", **more)


@pytest.fixture
def streamed(spark, tmp_path):
    """Write batches of rows as files one after the other, each run of the stream starting from the checkpoint of the last; gives all that is closed."""

    def run(batches, closing, late=None):
        source, numbers = tmp_path / "in", itertools.count()
        marks = []
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"part={next(numbers)}"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(source / "part=*"))
            query = windows.land(closing(stream), str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
            query.awaitTermination()
            marks.append(windows.watermark_of(query))
        return spark.read.parquet(str(tmp_path / "out")), spark.read.schema(SCHEMA).parquet(str(source / "part=*")), max(m for m in marks if m)

    return run


def rows_of(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_windows_sum_to_the_batch_counts_and_late_rows_are_counted(spark, streamed):
    first = [row(i, 60 * (i % 50) + i / 7, "dns" if i % 3 else "sip", "a" if i % 4 else "b") for i in range(400)]
    second = [row(1000 + i, 4000 + 13 * i) for i in range(200)] + [row(5000, None)]
    late = [row(2000, 10, "sip"), row(2001, 20, "sip"), row(2002, 6500, "sip")]
    closed, landed, mark = streamed([first, second, late, [row(9999, END, capture="end")]], lambda s: windows.window_counts(s, windows.protocol_keys()))
    total = Counter()
    for capture, protocol, packets in rows_of(closed, "capture_id", "protocol", "packets"):
        total[capture, protocol] += packets
    timed = landed.where("time_epoch IS NOT NULL AND capture_id != 'end'")
    missed = windows.late_rows(landed, closed, windows.protocol_keys(), mark)
    assert rows_of(missed, "capture_id", "protocol", "late") == [("a", "sip", 2)]
    total["a", "sip"] += 2
    assert sorted((*k, n) for k, n in total.items()) == rows_of(stats.protocol_counts(timed), "capture_id", "protocol", "packets")


def test_conversation_windows(spark, streamed):
    batches = [[row(100 * b + i, 300 * b + 7 * i, "dns" if i % 2 else "sip", transport=None if i % 5 else "udp") for i in range(60)] for b in range(3)]
    closed, landed, _ = streamed([*batches, [row(9999, END, capture="end")]], lambda s: windows.window_counts(s, windows.conversation_keys(), "2 minutes"))
    keys = ["capture_id", "transport", "src", "dst", "top_protocol"]
    want = stats.conversations(landed.where("capture_id != 'end'"))
    got = closed.groupBy(*keys).agg(F.sum("packets").alias("packet_count"), F.min("first_frame").alias("first_frame"))
    assert rows_of(got, *keys, "packet_count", "first_frame") == rows_of(want, *keys, "packet_count", "first_frame")
    assert closed.count() > want.count()


def test_sessions_equal_the_bursts_of_ordered_frames(spark, streamed):
    gaps = [0.5, 1.0, 1.000001, 0, 0.2, 0.3, 0.1, 1.0, 5, 0.1, 0.1, 0.1, 0.1, 0.1, 60, 0.9]
    second, rows = 100.0, []
    for i in range(160):
        second = round(second + gaps[i % len(gaps)], 6)
        rows.append(row(i, second, capture="a" if i < 130 else "b"))
    closed, landed, _ = streamed([rows[:70], rows[70:], [row(999, END, capture="end")]], lambda s: windows.session_bursts(s, delay="1 minute"))
    want = timing.bursts(landed.where("capture_id != 'end'"), ["capture_id"])
    assert rows_of(closed, "capture_id", "packet_count", "first_frame") == rows_of(want, "capture_id", "packet_count", "first_frame") != []


def test_timed_out_requests_come_once_and_equal_the_batch(spark, streamed):
    first = [ask(1, 10, "x"), answer(2, 11, "x"), ask(3, 12, "y"), ask(4, 13, "z"), ask(5, 14, "z"), ask(6, 15, "w"), ask(7, 16, "w", capture_id="b"), ask(8, None, "n")]
    second = [answer(20, 40, "w"), ask(21, 50, "x"), answer(22, 55, "z", capture_id="b"), ask(23, 60, "v"), answer(24, 90, "v"), answer(25, 90.000001, "x")]
    last = [ask(98, END, "end", capture_id="end"), answer(99, END, "end", capture_id="end")]
    closed, landed, _ = streamed([first, second, last], lambda s: windows.diameter_timeouts(s, delay="1 minute"))
    assert rows_of(closed, "frame_no", "hop_by_hop") == [(3, "y"), (4, "z"), (5, "z"), (7, "w"), (21, "x")]
    # Without answers beyond the timeout, and with one row per open run, these are the unanswered requests of the batch.
    timely = landed.where("time_epoch IS NOT NULL AND frame_no != 25")
    want = anomalies.unanswered_anomalies(anomalies.linked_diameter(anomalies.diameter_messages(timely)))
    got = closed.groupBy("capture_id", "hop_by_hop").agg(F.min("frame_no").alias("position"))
    assert rows_of(got, "capture_id", "position") == rows_of(want, "capture_id", "position")


def test_session_timeouts(spark, streamed):
    message = lambda frame, second, kind, seq: row(frame, second, "gtpv2", gtpv2_message_type=kind, gtpv2_seq_no=seq)
    rows = [message(1, 1, "32", "1"), message(2, 2, "33", "1"), message(3, 3, "32", "2"), message(4, 4, "33", "3"), message(5, 5, "34", "2"), message(6, 6, "32", None)]
    last = [message(8, END, "32", "9"), message(9, END, "33", "9")]
    closed, _, _ = streamed([rows, last], lambda s: windows.session_timeouts(s, delay="1 minute"))
    assert rows_of(closed, "frame_no", "seq") == [(3, "2")]


@pytest.mark.parametrize("delay", ["1 second", "1 minute"])
def test_timeouts_of_many_requests_and_answers_of_one_key(spark, streamed, delay):
    """Random times around the edges of the timeout, over three runs, against a plain loop; the watermark of the last run closes all but the last rows."""
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 400_000_000, 500_000) + rng.choice([0, 0, 1]) for _ in range(300))
    rows = [(ask if rng.random() < 0.7 else answer)(i, t / 1e6, rng.choice(["x", "y", "y", "z"]) if t < 100_000_000 or i % 9 else f"r{i}") for i, t in enumerate(times)]
    last = [ask(998, 400, "end"), answer(999, 400, "end")]
    closed, landed, _ = streamed([rows[:100], rows[100:200], rows[200:], last], lambda s: windows.diameter_timeouts(s, delay=delay))
    micros = {r[1]: round(float(r[2]) * 1e6) for r in [*rows, *last]}
    column = [c.split()[0] for c in SCHEMA.split(",")].index
    given = [(r[column("diameter_hop_by_hop_id")], micros[r[1]]) for r in rows if r[column("diameter_flags")] == "0x40"]
    open_ = [
        (r[1], r[column("diameter_hop_by_hop_id")], micros[r[1]]) for r in rows if r[column("diameter_flags")] == "0xc0"
        and not any(hop == r[column("diameter_hop_by_hop_id")] and 0 <= t - micros[r[1]] <= 30_000_000 for hop, t in given)
    ]
    wait = 1 if delay == "1 second" else 60
    got = rows_of(closed.select("frame_no", "hop_by_hop", F.unix_micros("asked_at").alias("us")), "frame_no", "hop_by_hop", "us")
    assert got == sorted(r for r in open_ if r[2] + 30_000_000 < (400 - wait) * 1_000_000) != []
    batch = windows.diameter_timeouts(landed.where("frame_no < 998")).select("frame_no", "hop_by_hop", F.unix_micros("asked_at").alias("us"))
    assert rows_of(batch, "frame_no", "hop_by_hop", "us") == sorted(open_)


def test_timeouts_join_no_request_with_every_answer(spark, tmp_path):
    spark.createDataFrame([ask(1, 1, "x")], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert "Join" not in windows.diameter_timeouts(stream)._jdf.queryExecution().analyzed().toString()
