"""Counts, bursts and timed-out requests of an index that keeps arriving, in event time.

All three keep state that a watermark bounds: what is ``delay`` behind the latest time seen is closed, written once, and forgotten.  The results are
append-only tables, so a Parquet sink with a checkpoint holds every closed window, session or request exactly once, also
after a restart.  Rows without a time take no part; rows that arrive for what is closed already change nothing, and ``late_rows`` counts them.

Every function takes the columns of the packet index and works on batches as well, where all windows are closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.operators.anomalies import CREATE_SESSION_REQUEST, CREATE_SESSION_RESPONSE, is_diameter_request
from tracemill.operators.timing import BURST_GAP_MS, BURST_SIZE

DELAY = "10 minutes"
WIDTH = "1 minute"
TIMEOUT = "30 seconds"


def with_event_time(index: DataFrame, epoch: str = "time_epoch") -> DataFrame:
    """Rows with a time, and that time to the microsecond as ``event_time``."""
    micros = (F.col(epoch).try_cast("decimal(24,6)") * 1000000).cast("bigint")
    return index.withColumn("event_time", F.timestamp_micros(micros)).where(F.col("event_time").isNotNull())


def protocol_keys() -> list[Column]:
    """The keys of the protocol histogram."""
    return [F.col("capture_id"), F.col("top_protocol").alias("protocol")]


def conversation_keys() -> list[Column]:
    """The keys of the conversation table."""
    known = lambda c, missing: F.coalesce(F.col(c), F.lit(missing))
    names = [known("transport", "ip").alias("transport"), known("src_ip", "unknown").alias("src"), known("dst_ip", "unknown").alias("dst")]
    return [F.col("capture_id"), *names, F.col("top_protocol")]


def window_counts(index: DataFrame, keys: Sequence[Column], width: str = WIDTH, delay: str = DELAY, order: str = "frame_no") -> DataFrame:
    """Packets and first frame per window of time and key.

    Rows are summed up before the shuffle, so a capture that holds most of a batch sends one row per window and key.
    """
    timed = with_event_time(index).select("event_time", order, *keys).withWatermark("event_time", delay)
    names = [c for c in timed.columns if c not in ("event_time", order)]
    counted = timed.groupBy(F.window("event_time", width), *names).agg(F.count(F.lit(1)).alias("packets"), F.min(order).alias("first_frame"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names, "packets", "first_frame")


def late_rows(index: DataFrame, closed: DataFrame, keys: Sequence[Column], watermark: str, width: str = WIDTH, order: str = "frame_no") -> DataFrame:
    """Packets per closed window and key that came too late to count: those of the landed index less those in the window."""
    whole = window_counts(index, keys, width, order=order).where(F.col("window_end") <= F.lit(watermark).cast("timestamp"))
    names = [c for c in whole.columns if c not in ("packets", "first_frame")]
    both = whole.select(*names, F.col("packets").alias("__all")).join(closed.select(*names, "packets"), names, "left")
    return both.withColumn("late", F.col("__all") - F.coalesce("packets", F.lit(0))).where("late > 0").select(*names, "late")


def session_bursts(index: DataFrame, max_gap_ms: float = BURST_GAP_MS, min_size: int = BURST_SIZE, delay: str = DELAY, order: str = "frame_no") -> DataFrame:
    """Runs of at least ``min_size`` packets of a capture with at most ``max_gap_ms`` between neighbours in time.

    The batch operator follows export order and cuts at every step back in time; sessions follow time.  Both are equal where frames are in order of time.
    A packet that comes exactly one gap later still belongs to the session, as in the batch.
    """
    timed = with_event_time(index).select("capture_id", order, "event_time").withWatermark("event_time", delay)
    session = F.session_window("event_time", f"{round(max_gap_ms * 1000)} microseconds")
    found = timed.groupBy("capture_id", session).agg(
        F.count(F.lit(1)).alias("packet_count"), F.min(order).alias("first_frame"), F.min("event_time").alias("start"), F.max("event_time").alias("end")
    )
    return found.where(F.col("packet_count") >= min_size).drop("session_window")


WAITING = "asked array<bigint>, kept array<string>, upto bigint, since bigint"


def _still_open(width: int) -> Callable:
    """State function of a key and slice: adds what arrives, gives the requests that the watermark closes without an answer, keeps the rest.

    ``upto`` is the latest answer of the slice, ``since`` the earliest time that the first answer of the next slice still covers.
    """

    def closed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, waiting, upto, since = int(key[-1]), [], None, None
        if state.exists:
            asked, kept, upto, since = state.get
            waiting = list(zip(asked, kept))
        for rows in () if state.hasTimedOut else batches:
            asks = rows["is_request"].to_numpy(bool)
            waiting += zip(rows["us"][asks].tolist(), rows["kept"][asks].tolist())
            given = rows["us"][~asks]
            slices = given // width
            own, following = given[slices == place], given[slices > place]
            if not own.empty:
                upto = int(own.max()) if upto is None else max(upto, int(own.max()))
            if not following.empty:
                first = int(following.min()) - width
                since = first if since is None else min(since, first)
        waiting = [(t, row) for t, row in waiting if (upto is None or t > upto) and (since is None or t < since)]
        mark = state.getCurrentWatermarkMs()
        done = [(t, row) for t, row in waiting if (t + width) // 1000 < mark]
        waiting = [(t, row) for t, row in waiting if (t + width) // 1000 >= mark]
        end = (place + 1) * width // 1000  # from here on no request of the slice can come
        if waiting or end > mark:
            state.update(([t for t, _ in waiting], [row for _, row in waiting], upto, since))
            state.setTimeoutTimestamp(max(mark + 1, min((t + width) // 1000 for t, _ in waiting) if waiting else end))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({**{f"k{n}": [k] * len(done) for n, k in enumerate(key[:-1])}, "kept": [row for _, row in done], "us": [t for t, _ in done]})

    return closed


def timed_out(messages: DataFrame, keys: Sequence[str], timeout: str = TIMEOUT, delay: str = DELAY) -> DataFrame:
    """Requests (``is_request``) without an answer of the same keys at the same time or up to ``timeout`` later, each once.

    Time is cut into slices as long as the timeout.  Its own slice answers a request exactly if the last answer there does not come before it, the next
    slice exactly if the first answer there comes in time.  So two times stand for all answers, and no request meets them one by one; an answer goes to its
    own slice and to the one before.  On a stream, open requests wait in the state of their keys and slice until the watermark has passed their timeout.
    """
    width = messages.sparkSession.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {timeout}"))).first()[0]
    others = [c for c in messages.columns if c not in (*keys, "event_time", "is_request")]
    out = [F.timestamp_micros("us").alias("asked_at") if c == "event_time" else F.col(c) for c in messages.columns if c != "is_request"]
    us, place = F.unix_micros("event_time"), F.floor(F.unix_micros("event_time") / width)
    # each side has a watermark of its own; the earlier one closes
    requests = messages.where("is_request").withWatermark("event_time", delay)
    answers = messages.where(~F.col("is_request")).dropna(subset=list(keys)).withWatermark("event_time", delay)
    given = answers.select("event_time", *keys, us.alias("us"), F.explode(F.array(place, place - 1)).alias("slice"))
    if not messages.isStreaming:
        own = F.floor(F.col("us") / width) == F.col("slice")
        first = F.min(F.when(~own, F.col("us"))) - width
        spans = given.groupBy(*keys, "slice").agg(F.max(F.when(own, F.col("us"))).alias("upto"), first.alias("since"))
        joined = requests.withColumn("us", us).withColumn("slice", place).join(spans, [*keys, "slice"], "left")
        return joined.where("NOT (coalesce(us <= upto, false) OR coalesce(us >= since, false))").select(*out)
    asked = requests.select("event_time", *keys, us.alias("us"), place.alias("slice"), F.to_json(F.struct(*others)).alias("kept"), F.lit(True).alias("is_request"))
    both = asked.unionByName(given.withColumn("kept", F.lit(None).cast("string")).withColumn("is_request", F.lit(False)))
    types = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    shape = ", ".join(f"k{n} {types[k]}" for n, k in enumerate(keys)) + ", kept string, us bigint"
    closed = both.groupBy(*keys, "slice").applyInPandasWithState(_still_open(width), shape, WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    row = F.from_json("kept", messages.select(*others).schema)
    named = closed.select(*[F.col(f"k{n}").alias(k) for n, k in enumerate(keys)], row.alias("row"), "us")
    return named.select(*keys, "row.*", "us").select(*out)


def diameter_timeouts(index: DataFrame, timeout: str = TIMEOUT, delay: str = DELAY) -> DataFrame:
    """Diameter requests that timed out: capture, frame, hop-by-hop id, command and time."""
    rows = with_event_time(index).where("(diameter_flags IS NOT NULL OR diameter_cmd_code IS NOT NULL) AND diameter_hop_by_hop_id IS NOT NULL")
    messages = rows.select(
        "capture_id", "frame_no", F.col("diameter_hop_by_hop_id").alias("hop_by_hop"), F.coalesce("diameter_cmd_code", F.lit("?")).alias("cmd"),
        "event_time", is_diameter_request(F.col("diameter_flags")).alias("is_request"),
    )
    return timed_out(messages, ["capture_id", "hop_by_hop"], timeout, delay)


def session_timeouts(index: DataFrame, timeout: str = TIMEOUT, delay: str = DELAY) -> DataFrame:
    """Create-session requests that timed out: capture, frame, sequence number and time."""
    kind = F.col("gtpv2_message_type")
    rows = with_event_time(index).where(kind.isin(CREATE_SESSION_REQUEST, CREATE_SESSION_RESPONSE) & F.col("gtpv2_seq_no").isNotNull())
    messages = rows.select("capture_id", "frame_no", F.col("gtpv2_seq_no").alias("seq"), "event_time", (kind == CREATE_SESSION_REQUEST).alias("is_request"))
    return timed_out(messages, ["capture_id", "seq"], timeout, delay)


def land(closed: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append what is closed to a Parquet folder; ``available_now`` ends after the files that are there."""
    writer = closed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watermark_of(query: StreamingQuery) -> str | None:
    """The latest watermark that the query reported, None before the first."""
    seen = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p.get("eventTime", {})]
    return max(seen, default=None)
