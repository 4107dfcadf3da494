"""Hard negatives for contrastive training, from an inverted multi-index.

For every anchor the ``k`` best other rows of its label are its positives; for every positive the ``k`` best rows of another label whose score
lies between ``low`` percent of the positive's score and that score are its hard negatives.  Scores are inner products of vectors whose components
are ``floor(scale * x)``, in whole numbers; higher ones come first, ties go to the smaller vec_id.

1. *Codebooks.*  Both halves of the vectors get a codebook by k-means on a sample of SAMPLE_ROWS rows.  A pair of codewords is a cell;
   every row is indexed in the cell of its two nearest codewords.
2. *Bounds.*  Over all rows Spark takes, per codeword, the radius (largest distance of a half to its codeword) and the reach (largest length of a
   half), and per cell the rows.  No half of a codeword scores above ``min(q.c + |q| * radius, |q| * reach)`` with the half q of an anchor; the sum
   of two such bounds holds for the cell.
3. *Walk.*  A multi-sequence heap takes the cells of an anchor by falling sum of both bounds.  Below a score that the anchor's windows
   can do without, the walk ends: what was not visited cannot enter a window.
4. *Windows.*  A pilot walk over the first PILOT_ROWS rows gives each window its k-th score so far; the certified walk visits
   every cell whose bound reaches it.  First for the positives (one window without upper end), then for the negatives (one window per positive).

A walk turns anchors into requests (cell, some anchors); they meet the blocks of that cell, at most BLOCK_ROWS rows each, and each meeting is one
matrix product that returns at most k rows per window.  Nothing is dropped for a full cell: it has more blocks.  The directory (a row per cell, at most
MOST_CODEWORDS squared) and the codebooks go to all tasks.  How much is visited depends on the vectors: clusters are skipped by the bounds, while
directions without any structure leave every bound above the windows, and then every anchor meets every row.

Defined cases: a row takes no part if its vec_id, label or vector is null, its vector is empty or has null or non-finite components (scaled ones included), or
another length than the most frequent one (the longer one of equally frequent).  Zero vectors take part.  Rows that repeat a vec_id take part each,
but not as positives or negatives of an anchor of that id; an anchor that is there twice is mined twice.  A window whose positive scores below 0 is empty.  Inner products beyond
2**55 count as 2**55.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Run, smallest

K = 5
LOW = 80
SCALE = 256
SAMPLE_ROWS = 8192
CELL_ROWS = 256
MOST_CODEWORDS = 256
PILOT_ROWS = 2048
BLOCK_ROWS = 2048
ANCHOR_ROWS = 128
SEED = 5
MOST = 1 << 55
ENDLESS = 1e300
ROUNDS = 8


def nearest(halves: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    """The place of the nearest codeword of each row."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = (codewords * codewords).sum(axis=1) - 2 * halves @ codewords.T
    return np.nan_to_num(far, nan=np.inf).argmin(axis=1)


def k_means(halves: np.ndarray, codewords: int, seed: int = SEED) -> np.ndarray:
    """Codewords of a sample, at most as many as it has different rows."""
    if not halves.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(halves, axis=0)
    centres = distinct[np.sort(np.random.default_rng(seed).permutation(len(distinct))[:codewords])]
    for _ in range(ROUNDS):
        place = nearest(halves, centres)
        counts = np.bincount(place, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, place, halves)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks; after the pass over all rows also their radii, reaches and the rows of each cell."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    reaches: tuple[np.ndarray, np.ndarray] | None = None
    rows: np.ndarray | None = None

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return vectors[:, :cut], vectors[:, cut:]

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The cell of each vector, and of its two halves the distance to the codeword and the length."""
        places = [nearest(h, b) for h, b in zip(self.halves(vectors), self.books, strict=True)]
        with np.errstate(over="ignore"):
            far = [np.sqrt(((h - b[p]) ** 2).sum(axis=1)) for h, b, p in zip(self.halves(vectors), self.books, places, strict=True)]
            long = [np.sqrt((h * h).sum(axis=1)) for h in self.halves(vectors)]
        return places[0] * len(self.books[1]) + places[1], far, long

    def half_bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Per half and anchor, what no vector of a codeword can exceed; -ENDLESS for codewords without vectors."""
        out = []
        for half, book, radius, reach in zip(self.halves(anchors), self.books, self.radii, self.reaches, strict=True):
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.sqrt((half * half).sum(axis=1))[:, None]
                bound = np.minimum(half @ book.T + length * radius, length * reach)
                slack = 1 + 1e-9 * length * (reach + np.sqrt((book * book).sum(axis=1)))
            out.append(np.where(reach < 0, -ENDLESS, np.nan_to_num(bound + slack, nan=ENDLESS / 4, posinf=ENDLESS / 4)))
        return out

    def walk(self, first: np.ndarray, second: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
        """Cells with rows and their rows, by falling sum of bounds down to ``least``: the multi-sequence heap."""
        left, right = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        u, v = first[left].tolist(), second[right].tolist()
        left, right = left.tolist(), right.tolist()
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < least:
                return
            rows = int(self.rows[left[i], right[j]])
            if rows:
                yield left[i] * len(right) + right[j], rows
            # (i, j) has one way in: from the left in the first row, else from above.
            if i == 0 and j + 1 < len(v):
                heapq.heappush(heap, (-(u[0] + v[j + 1]), 0, j + 1))
            if i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[j]), i + 1, j))


def scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered vectors as 64-bit numbers."""
    with np.errstate(over="ignore"):
        most = np.sqrt((anchors * anchors).sum(axis=1)).max(initial=0) * np.sqrt((vectors * vectors).sum(axis=1)).max(initial=0)
    if most < 1 << 52:  # every partial sum is a whole number that a double holds
        return (anchors @ vectors.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape) for rows in (anchors, vectors)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


def usable(embeddings: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """vec_id, label and whole-numbered vector of the rows that take part, and the length of the vectors."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: _floor(scale * x))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0").where(F.forall("vector", finite))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).take(1)
    length = lengths[0]["length"] if lengths else 0
    return rows.where(F.size("vector") == length), length


def _floor(x: Column) -> Column:
    """The floor of a double as a double; Spark's own goes through 64-bit numbers."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, length)


def _packed(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows)]


INDEXED = "cell int, vec_id long, label long, vector binary, far_0 double, far_1 double, long_0 double, long_1 double"
BLOCKS = "cell int, ids binary, labels binary, vectors binary"
REQUESTS = "cell int, keys binary, anchor_ids binary, anchor_labels binary, anchors binary, windows binary, lows binary, highs binary"
FOUND = "key long, window int, vec_id long, score long"


class Miner:
    """The index of a table and the walks over it."""

    def __init__(self, embeddings: DataFrame, scale: int = SCALE, pilot_rows: int = PILOT_ROWS, cell_rows: int = CELL_ROWS, most_codewords: int = MOST_CODEWORDS):
        self.spark, self.run, self.pilot_rows = embeddings.sparkSession, Run(embeddings.sparkSession, "hardnegatives"), pilot_rows
        rows, self.length = usable(embeddings, scale)
        if not self.length:
            return
        rows = self.run.land(rows, "rows")
        sample = smallest(rows.select("vec_id", "vector"), "vec_id", SAMPLE_ROWS).toArrow()
        vectors = sample.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, self.length)
        codewords = int(min(most_codewords, max(2, round((rows.count() / cell_rows) ** 0.5))))
        cut = self.length // 2
        plain = MultiIndex((k_means(vectors[:, :cut], codewords), k_means(vectors[:, cut:], codewords)))
        self.indexed = self.run.land(self._indexed(rows, plain), "indexed")
        self.index = self.spark.sparkContext.broadcast(self._directory(plain))
        self.blocks = self.run.land(self._blocks(), "blocks")
        self.passes = 0

    def _indexed(self, rows: DataFrame, plain: MultiIndex) -> DataFrame:
        index, length = self.spark.sparkContext.broadcast(plain), self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
                    cells, far, long = index.value.place(vectors)
                    columns = [pa.array(cells, pa.int32()), part.column("vec_id"), part.column("label"), pa.array(_packed(vectors), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (*far, *long))], ["cell", "vec_id", "label", "vector", "far_0", "far_1", "long_0", "long_1"])

        return rows.mapInArrow(run, INDEXED)

    def _directory(self, plain: MultiIndex) -> MultiIndex:
        """One row per cell comes to the driver, at most MOST_CODEWORDS squared."""
        names = ("far_0", "far_1", "long_0", "long_1")
        cells = self.indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.max(n).alias(n) for n in names)).toPandas()
        shape = (len(plain.books[0]), len(plain.books[1]))
        rows = np.zeros(shape, dtype=np.int64)
        at = np.unravel_index(cells["cell"].to_numpy(), shape)
        rows[at] = cells["n"].to_numpy()
        most = {n: np.full(shape[int(n[-1])], -1.0) for n in names}
        for n in names:
            np.maximum.at(most[n], at[int(n[-1])], cells[n].to_numpy())
        return MultiIndex(plain.books, (most["far_0"], most["far_1"]), (most["long_0"], most["long_1"]), rows)

    def _blocks(self) -> DataFrame:
        """The rows of a cell, at most BLOCK_ROWS to a row; a full cell is dealt over several tasks by vec_id."""
        rows = self.index.value.rows.ravel()
        parts = max(1, int(-(-rows.sum() // (8 * BLOCK_ROWS))))
        spread = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(-(-rows.max(initial=1) // (4 * BLOCK_ROWS))))))
        dealt = self.indexed.select("cell", "vec_id", "label", "vector").repartition(parts, "cell", spread).sortWithinPartitions("cell", "vec_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                ends = [*(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else []
                first = 0
                for end in ends:
                    for at in range(first, end, BLOCK_ROWS):
                        part = batch.slice(at, min(BLOCK_ROWS, end - at))
                        made = [part.column("vec_id").to_numpy().tobytes(), part.column("label").to_numpy().tobytes(), b"".join(part.column("vector").to_pylist())]
                        yield pa.RecordBatch.from_arrays([pa.array([int(cells[at])], pa.int32()), *(pa.array([m], pa.binary()) for m in made)], ["cell", "ids", "labels", "vectors"])
                    first = end

        return dealt.mapInArrow(run, BLOCKS)

    def anchors(self, is_anchor: Column) -> DataFrame:
        """key, cell, vec_id, label and vector of the anchors."""
        chosen = self.indexed.where(is_anchor).select("cell", "vec_id", "label", "vector").withColumn("key", F.monotonically_increasing_id())
        return self.run.land(chosen, "anchors")

    def visit(self, anchors: DataFrame, same: bool, k: int, pilot: bool) -> DataFrame:
        """key, window, vec_id and score: the k best rows of each window (from lows to highs) of the anchors, of the same or of another label.

        A pilot ends after pilot_rows rows.
        """
        index, length, most_rows = self.index, self.length, self.pilot_rows if pilot else float("inf")

        def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ANCHOR_ROWS):
                    part = batch.slice(at, ANCHOR_ROWS)
                    vectors, lows, highs = _matrix(part.column("vector"), length), part.column("lows").to_pylist(), part.column("highs").to_pylist()
                    keys, ids, labels = (part.column(n).to_numpy() for n in ("key", "vec_id", "label"))
                    asked: dict[int, list[int]] = {}
                    bounds = index.value.half_bounds(vectors)
                    for row in range(len(keys)):
                        seen = 0
                        for cell, rows in index.value.walk(bounds[0][row], bounds[1][row], min(lows[row])):
                            asked.setdefault(cell, []).append(row)
                            seen += rows
                            if seen >= most_rows:
                                break
                    for cell, rows in asked.items():
                        counts = np.array([len(lows[r]) for r in rows], dtype=np.int64)
                        flat = [np.array([x for r in rows for x in side[r]], dtype=np.int64) for side in (lows, highs)]
                        made = [np.ascontiguousarray(a).tobytes() for a in (keys[rows], ids[rows], labels[rows], vectors[rows], counts, *flat)]
                        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([m], pa.binary()) for m in made)], [n.split()[0] for n in REQUESTS.split(", ")])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = ("ids", "labels", "keys", "anchor_ids", "anchor_labels", "windows", "lows", "highs")
            for batch in batches:
                for row in range(batch.num_rows):
                    held = {n: np.frombuffer(batch.column(n)[row].as_py(), dtype=np.int64) for n in numbers}
                    found = scores(*(np.frombuffer(batch.column(n)[row].as_py(), dtype=np.float64).reshape(-1, length) for n in ("anchors", "vectors")))
                    yield _best(held, found, same, k)

        count = max(1, -(-anchors.count() // (4 * ANCHOR_ROWS)))
        requests = anchors.repartition(count, "cell").sortWithinPartitions("cell").mapInArrow(request, REQUESTS)
        # Spark would judge the requests by the size of the anchors, many times below their own, and broadcast them.
        met = self.blocks.hint("merge").join(requests, "cell").drop("cell")
        best = Window.partitionBy("key", "window").orderBy(F.desc("score"), "vec_id")
        found = met.mapInArrow(meet, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        self.passes += 1
        return self.run.land(found, f"pass-{self.passes}")

    def certified(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best rows of each window: a pilot raises the lower ends, then every cell that can reach them is visited."""
        pilot = self.visit(anchors, same, k, pilot=True)
        raised = pilot.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("bars"))
        bar = lambda low, window: F.coalesce(F.try_element_at(F.col("bars"), window.cast("int")), low)
        anchors = anchors.join(raised, "key", "left").withColumn("lows", F.transform("lows", bar)).drop("bars")
        return self.visit(anchors, same, k, pilot=False)


def _best(held: dict[str, np.ndarray], found: np.ndarray, same: bool, k: int) -> pa.RecordBatch:
    """At most k rows per window of each anchor from one block."""
    ids, starts = held["ids"], np.concatenate([[0], np.cumsum(held["windows"])])
    allowed = ((held["anchor_labels"][:, None] == held["labels"][None, :]) == same) & (held["anchor_ids"][:, None] != ids[None, :])
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for row, key in enumerate(held["keys"]):
        lows, highs = (held[n][starts[row] : starts[row + 1]] for n in ("lows", "highs"))
        chosen = np.flatnonzero(allowed[row] & (found[row] >= lows.min()) & (found[row] <= highs.max()))
        if not len(chosen):
            continue
        order = chosen[np.lexsort((ids[chosen], -found[row, chosen]))]
        sorted_ids, sorted_scores = ids[order], found[row, order]
        for window, (low, high) in enumerate(zip(lows, highs, strict=True)):
            first = np.searchsorted(-sorted_scores, -high, side="left")
            last = min(first + k, np.searchsorted(-sorted_scores, -low, side="right"))
            if first < last:
                out.append((key, window, sorted_ids[first:last], sorted_scores[first:last]))
    sizes = [len(o[2]) for o in out]
    none = np.empty(0, dtype=np.int64)
    columns = [
        pa.array(np.repeat(np.array([o[0] for o in out], dtype=np.int64), sizes)),
        pa.array(np.repeat(np.array([o[1] for o in out], dtype=np.int32), sizes), pa.int32()),
        pa.array(np.concatenate([none, *(o[2] for o in out)])),
        pa.array(np.concatenate([none, *(o[3] for o in out)])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["key", "window", "vec_id", "score"])


def mine(embeddings: DataFrame, is_anchor: Column, k: int = K, low: int = LOW, scale: int = SCALE, **index: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``is_anchor`` is a condition on vec_id and label."""
    miner = Miner(embeddings, scale, **index)
    if not miner.length:
        names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return miner.spark.createDataFrame([], names)
    anchors = miner.anchors(is_anchor)
    whole = [F.array(F.lit(end).cast("long")).alias(name) for name, end in (("lows", -MOST), ("highs", MOST))]
    positives = miner.certified(anchors.select("*", *whole), True, k)
    positives = positives.select("key", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The k positives of an anchor in order; their scores fall, so those with a window, 0 or above, come first.
    bounded = positives.where("positive_score >= 0").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("held"))
    highs = F.transform("held", lambda p: p["positive_score"])
    lows = F.transform("held", lambda p: F.call_function("div", low * p["positive_score"] + 99, F.lit(100)))
    windows = anchors.join(bounded.select("key", highs.alias("highs"), lows.alias("lows")), "key")
    negatives = miner.certified(windows, False, k)
    names = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    rows = negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(positives, ["key", "window"]).join(names, "key")
    return rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
