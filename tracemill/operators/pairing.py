"""Request / response pairing, first in first out per key.

With S the running sum of +1 per request and -1 per response, a response finds a waiting request
exactly when S does not fall below the smallest earlier S (or 0).  The k-th request then belongs
to the k-th such response.  Both steps are block scans, so one key may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import labels
from tracemill.functions.ordering import BLOCK, with_block
from tracemill.session import cut_lineage


def fifo_pairs(df: DataFrame, keys: Sequence[str], order: str, request: str, block_rows: int | None = None) -> DataFrame:
    """Pairs ``(keys, request, response)`` of order values.  Keys must not be null."""
    rows = with_block(df.select(*keys, order, F.col(request).alias("_asks")), order, block_rows)
    rows = rows.withColumn("_step", F.when(F.col("_asks"), 1).otherwise(-1).cast("bigint"))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order)
    upto, past = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", F.sum("_step").over(upto)).withColumn("_n", F.row_number().over(inside))
    rows = rows.withColumn("_low", F.min("_sum").over(past))

    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, BLOCK).agg(
        F.sum("_step").alias("_total"), F.min("_sum").alias("_lowest"), F.count(F.lit(1)).alias("_rows")
    )
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0)))
    blocks = blocks.withColumn("_rows_before", F.coalesce(F.sum("_rows").over(across), F.lit(0)))
    blocks = blocks.withColumn("_carried_low", F.min(F.col("_before") + F.col("_lowest")).over(across))
    rows = rows.join(blocks.select(*keys, BLOCK, "_before", "_rows_before", "_carried_low"), [*keys, BLOCK])

    level, seen = F.col("_before") + F.col("_sum"), F.col("_rows_before") + F.col("_n")
    floor = F.least(F.lit(0), F.col("_carried_low"), F.col("_before") + F.col("_low"))  # least skips nulls
    asked = (seen + level) / 2  # requests so far: half of rows plus their balance
    # answers so far = requests so far minus those still waiting, which is the height above the floor
    answered = asked - (level - F.least(floor, level))
    matched = ~F.col("_asks") & (level >= floor)
    nth = F.when(F.col("_asks"), asked).when(matched, answered).cast("bigint")
    return (
        rows.select(*keys, F.col(order).alias("_order"), "_asks", nth.alias("_nth"))
        .where(F.col("_nth").isNotNull())
        .groupBy(*keys, "_nth")
        .agg(
            F.max(F.when(F.col("_asks"), F.col("_order"))).alias("request"),
            F.max(F.when(~F.col("_asks"), F.col("_order"))).alias("response"),
        )
        .where(F.col("request").isNotNull() & F.col("response").isNotNull())
        .drop("_nth")
    )


def pair_keys(events: DataFrame) -> DataFrame:
    """Strict and loose pairing keys; a response carries the key of the request it answers."""
    rows = events.withColumn("_answers", F.expr(labels.is_response())).withColumn("_base", F.expr(labels.base_name()))
    route = "if(_answers, concat_ws('|', dst_node, src_node), concat_ws('|', src_node, dst_node))"
    key = lambda name: f"concat_ws('|', coalesce(protocol, ''), {name}, {route})"
    return rows.selectExpr(
        "capture_id",
        "event_no",
        "not _answers as asks",
        "correlation_id is not null as has_id",
        f"{key('coalesce(correlation_id, _base)')} as strict_key",
        f"{key('_base')} as loose_key",
    )


def pair_events(events: DataFrame, block_rows: int | None = None, order: str = "matches") -> DataFrame:
    """Pairs ``(capture_id, request, response, by)`` of event numbers.

    Events are paired by correlation id, or by message name where there is none; responses with an
    id that find no request are then tried by name.

    * ``order="matches"``: all matches by id come before any match by name, and only requests still open are tried by name. No event is
      in two pairs.
    * ``order="events"``: the events are walked in order and each response decides at once. A request waits under its id and under its
      name, and each queue forgets it only when it is taken there, so a request can be in two pairs, one by id and one by name; a response never is.
      The queue of an id does not depend on any queue of names: which responses find their id is one first-in-first-out pass, and the rest, in
      order, meets all requests in a second one. So no running state per key is needed here either. Ids and message names do not share queues.

    The narrow keys and the first pairs are written once, since both are read twice.
    """
    if order not in ("matches", "events"):
        raise ValueError(f"unknown pairing order: {order}")
    keyed = cut_lineage(pair_keys(events))
    by_id = keyed if order == "matches" else keyed.where("has_id")
    strict = cut_lineage(fifo_pairs(by_id, ["capture_id", "strict_key"], "event_no", "asks", block_rows).drop("strict_key"))
    if order == "matches":
        done = strict.select("capture_id", F.explode(F.array("request", "response")).alias("event_no"))
        rest = keyed.where("asks or has_id")
    else:
        done = strict.select("capture_id", F.col("response").alias("event_no"))
        rest = keyed
    waiting = rest.join(done, ["capture_id", "event_no"], "left_anti")
    loose = fifo_pairs(waiting, ["capture_id", "loose_key"], "event_no", "asks", block_rows).drop("loose_key")
    return strict.withColumn("by", F.lit("strict")).unionByName(loose.withColumn("by", F.lit("loose")))


def write_back(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Link both ends of each pair; the response gets status ``response`` unless it is an error.

    A request in two pairs is linked to the later response.
    """
    ends = pairs.selectExpr(
        "capture_id",
        "inline(array(struct(request as event_no, response as paired_no, false as _answer),"
        " struct(response as event_no, request as paired_no, true as _answer)))",
    )
    ends = ends.groupBy("capture_id", "event_no").agg(F.max("paired_no").alias("paired_no"), F.max("_answer").alias("_answer"))
    linked = events.join(ends, ["capture_id", "event_no"], "left")
    status = F.expr("if(_answer and status <> 'error', 'response', status)")
    answer = F.coalesce("_answer", F.lit(False))
    return (
        linked.withColumn("is_response", F.col("is_response") | answer)
        .withColumn("is_request", F.col("is_request") & ~answer)
        .withColumn("status", status)
        .withColumn("message_type", F.col("status"))
        .withColumn("paired_event_id", F.concat(F.lit("event-"), F.col("paired_no").cast("string")))
        .drop("paired_no", "_answer")
    )
