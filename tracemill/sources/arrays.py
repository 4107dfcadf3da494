"""Items of files that are one JSON array each, read in many tasks.

A text source that ends its rows at closing braces cuts such a file wherever Spark cuts files, however few lines it has.  Whether a row begins
inside a string, and at which depth, follows from all rows before it: every split first reports how its quotes and brackets add up, for both ways it may
begin; running sums over the few rows of a file, one per split, give each split its start; and a second read cuts the items.  An item that reaches over splits
comes in pieces, which are joined by file and place; nothing else is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.session import cut_lineage
from tracemill.sources.index import capture_key

_ESCAPED = re.compile(r"\\.", re.S)
_BETWEEN = " \t\r\n,["
SUMS = "path string, start long, plain long, quoted long, quotes long, size long, rows long"
PARTS = "path string, start long, place long, head boolean, whole boolean, value string"


def depth_change(row: str, in_string: bool) -> tuple[int, bool]:
    """How much deeper a row ends than it begins, and whether it ends inside a string."""
    if "\\" in row:
        row = _ESCAPED.sub("", row)
    parts = row.split('"')
    outside = "".join(parts[1::2] if in_string else parts[::2])
    change = outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
    return change, in_string ^ (len(parts) % 2 == 0)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its change of depth if it begins outside or inside a string, its quotes, bytes and rows."""
    held: dict[tuple[str, int], list] = {}
    for batch in batches:
        for path, start, value, size in zip(*(batch.column(n).to_pylist() for n in ("path", "start", "value", "size")), strict=True):
            own = held.setdefault((path, start), [0, 0, False, True, 0, 0])
            for i in (0, 1):
                change, own[2 + i] = depth_change(value + "}", own[2 + i])
                own[i] += change
            own[4] += size
            own[5] += 1
    rows = [(*key, own[0], own[1], int(own[2]), own[4], own[5]) for key, own in held.items()]
    columns = [c.split() for c in SUMS.split(", ")]
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in columns])
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class _Cutter:
    """Cuts the rows of one split into items and pieces of items."""

    def __init__(self, path: str, start: int, depth: int, in_string: bool, unended: bool):
        self.key, self.depth, self.in_string, self.unended = (path, start), depth, in_string, unended
        self.place, self.head, self.held = 0, depth <= 1, []
        self.out: list[tuple] = []

    def emit(self, head: bool, whole: bool, value: str) -> None:
        self.out.append((*self.key, self.place, head, whole, value))
        self.place += 1

    def add(self, row: str) -> None:
        change, self.in_string = depth_change(row, self.in_string)
        if self.head and not self.held:
            begin = row.find("{")
            between = (row if begin < 0 else row[:begin]).strip(_BETWEEN + "]")
            if between:
                self.emit(True, True, between)  # what stands beside the objects is an item of its own
            row = "" if begin < 0 else row[begin:]
        if row:
            self.held.append(row)
        self.depth += change
        if self.held and self.depth <= 1 and not self.in_string:
            self.emit(self.head, self.head, "".join(self.held))
            self.held, self.head = [], True

    def end(self) -> None:
        if self.held:
            self.emit(self.head, False, "".join(self.held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("path", "start", "depth", "inside", "unended", "value")
    cutter: _Cutter | None = None
    waiting: str | None = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PARTS.split(", ")])

    def closed() -> list[tuple]:
        # The last row of a file that does not end with a brace has none.
        cutter.add(waiting + ("" if cutter.unended else "}"))
        cutter.end()
        return cutter.out

    for batch in batches:
        done: list[tuple] = []
        for path, start, depth, inside, unended, value in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if cutter is None or cutter.key != (path, start):
                done += closed() if cutter else []
                cutter = _Cutter(path, start, depth, inside, unended)
            else:
                cutter.add(waiting + "}")
            waiting = value
        if cutter:
            done, cutter.out = done + cutter.out, []
        yield made(done)
    if cutter:
        yield made(closed())


def array_items(spark: SparkSession, path: str | Sequence[str], root: str | Sequence[str] | None = None) -> DataFrame:
    """(capture_id, value): the text of every object of the arrays, and of whatever else stands between them.

    An item that the end of its file cuts off comes as far as it goes.  ``_metadata`` names files and splits, so any file system that Spark reads will do.
    """
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("file_size")]
    rows = spark.read.option("lineSep", "}").text(path).select(*meta, "value")
    sizes = rows.select("path", "start", "value", F.octet_length("value").cast("long").alias("size"))
    files = rows.groupBy("path", "start").agg(F.max("file_size").alias("file_size"))
    sums = cut_lineage(sizes.mapInArrow(_sums, SUMS).groupBy("path", "start").agg(*(F.sum(c).alias(c) for c in ("plain", "quoted", "quotes", "size", "rows"))).join(files, ["path", "start"]))
    # One row per split, so a file has as many as it has blocks.
    whole = Window.partitionBy("path")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    begun = begun.withColumn("change", F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain")))
    short = F.sum(F.col("size") + F.col("rows")).over(whole) > F.col("file_size")
    last = F.col("start") == F.max("start").over(whole)
    begun = cut_lineage(begun.select("path", "start", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), "inside", (short & last).alias("unended")))
    # The starts of all splits, about a hundred bytes for every block of a file, go to every task, so that rows stay in their order.
    parts = cut_lineage(rows.drop("file_size").join(F.broadcast(begun), ["path", "start"]).mapInArrow(_cut, PARTS))
    capture = capture_key(F.col("path"), path if root is None else root).alias("capture_id")
    nth = F.sum(F.col("head").cast("int")).over(Window.partitionBy("path").orderBy("start", "place"))
    pieces = parts.where("NOT whole").withColumn("nth", nth).groupBy("path", "nth")
    joined = pieces.agg(F.array_sort(F.collect_list(F.struct("start", "place", "value"))).alias("held"))
    joined = joined.select("path", F.array_join(F.transform("held", lambda p: p["value"]), "").alias("value"))
    return parts.where("whole").select("path", "value").unionAll(joined).select(capture, "value")
