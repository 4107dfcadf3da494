"""Components of documents whose sets of word n-grams are similar, by a Jaccard join with prefix filtering.

A document is its set of distinct runs of WORDS words (lower-case A-Z, words end at white space); one with fewer words has one run, all its words.
Two documents link when ``100 * |common| >= SHARE * |union|``; components are those of all links.

1. *Rare first.*  Spark counts all n-grams of all documents in 2**SKETCH_BITS cells by hash.  (cell count, hash) is the common order of all sets: what is
   rare comes first.  Any common order gives the same links; a coarse one only leaves more candidates.
2. *Prefixes.*  Equal sets count once.  Two sets that link share at least ``SHARE`` percent of the larger one, so they share one of the first
   ``n - ceil(SHARE * n / 100) + 1`` n-grams of both.  Only these are shuffled, and only those that two sets hold go on.
3. *Candidates.*  An n-gram that at most PAIRED sets hold pairs them all.  One that more sets hold pairs each of them with its head only, the set that shares most.  A pair
   stays once, if its sizes (length filter), the places of the n-gram (positional filter) and its counts by hash range (suffix filter: sets differ at least by the sum
   of the differences of their counts over a partition) let it reach the share.
4. *Verification.*  The sets of a pair left are compared whole, once per pair.
5. *Rest.*  Two sets that met under one head, and whose components still differ, are compared in blocks: a unit of work is a pair of blocks of one head, at most
   about BLOCK_GRAMS n-grams and BLOCK_SETS sets each.  A first round runs the length and suffix filters over all pairs of a unit at once; for the sets that pass with
   any other, a second round takes the common n-grams of all pairs from one product of 0-1 matrices, and a unit returns at most one link less than it has sets.

So every pair that shares a prefix n-gram is filtered, compared, or already in one component, and no group of copies is written as all its pairs.

Defined cases: null counts as the empty text; documents without words have no set and are linked with nothing, not with each other either.  A row's component
is the smallest doc_id it reaches, its own included; rows without doc_id are linked as others, and a component of such rows only has none.  Repeated rows, and rows
that share a doc_id, are rows of their own.  Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import hashing
from tracemill.llm.common import Run, byte_slices
from tracemill.llm.graph import components
from tracemill.llm.hashing import mix

WORDS = 4
SHARE = 85
SKETCH_BITS = 18
RANGES = 32
PAIRED = 16
BLOCK_GRAMS = 1 << 18
BLOCK_SETS = 512
PREFIX_BITS = 20

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[32, *range(9, 14)]] = False
_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each text."""
    words, bounds = hashing.word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], _WORD_BYTE)
    count = max(0, len(words) - WORDS + 1)
    runs = np.zeros(count, dtype=np.uint64)
    for place in range(WORDS):
        runs += words[place : place + count] * _PLACES[place]
    runs = mix(runs)
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first >= WORDS:
            yield np.unique(runs[first : last - WORDS + 1])
        elif last > first:
            few = words[first:last] * _PLACES[: last - first]
            yield mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(last - first))
        else:
            yield np.empty(0, dtype=np.uint64)


def cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def least_common(n: int) -> int:
    """What a set of n n-grams shares at least with any set it links to."""
    return -(-SHARE * n // 100)


def prefix(grams: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The rarest n-grams of a set, rarest first, one of which it shares with every set it links to."""
    length = len(grams) - least_common(len(grams)) + 1
    order = np.lexsort((grams, frequency[cell(grams)]))
    return grams[order[:length]]


def range_counts(grams: np.ndarray, ranges: int = RANGES) -> np.ndarray:
    """How many n-grams of a set lie in each range of hashes (by the low bits; the high ones order the set)."""
    return np.bincount((grams & np.uint64(ranges - 1)).astype(np.int64), minlength=ranges)


def outline(grams: np.ndarray) -> bytes:
    """Counts by range, a byte each, with two to four n-grams a range on average and RANGES ranges at least."""
    ranges = max(RANGES, 1 << (max(1, -(-len(grams) // 4)) - 1).bit_length())
    return np.minimum(range_counts(grams, ranges), 255).astype(np.uint8).tobytes()


def least_different(a: bytes, b: bytes) -> int:
    """A number of n-grams in which two sets differ at least, by their outlines; the finer one is folded to the other's ranges."""
    x, y = (np.frombuffer(o, dtype=np.uint8).astype(np.int64) for o in (a, b))
    ranges = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, ranges).sum(axis=0) - y.reshape(-1, ranges).sum(axis=0)).sum())


def most_different(n_a, n_b):
    """In how many n-grams two linked sets can differ: n_a + n_b less twice the fewest they share."""
    return n_a + n_b - 2 * ((SHARE * (n_a + n_b) + 99 + SHARE) // (100 + SHARE))


def row_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def frequencies(documents: DataFrame) -> np.ndarray:
    """The n-grams of all documents by cell; the result has 2**SKETCH_BITS numbers, whatever the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for _, texts in byte_slices(batch, "text"):
                table += np.bincount(cell(np.concatenate([*gram_sets(texts)])), minlength=len(table))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(table[used])], ["cell", "n"])

    counted = documents.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    table[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return table


def _signed(frequency: Broadcast):
    """Of each row the key of its set, its size, prefix and outline; nulls without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                sets = [*gram_sets(texts)]
                filled = [len(s) > 0 for s in sets]
                columns = [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, filled, strict=True)], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([prefix(s, frequency.value).view(np.int64) if f else None for s, f in zip(sets, filled, strict=True)], pa.list_(pa.int64())),
                    pa.array([outline(s) if f else None for s, f in zip(sets, filled, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SIGNED.split(", ")])

    return run


SIGNED = "doc_id long, text_key binary, set_key binary, n long, prefix array<long>, outline binary"


def _gram_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in byte_slices(batch, "text"):
            made = pa.array([s.tobytes() for s in gram_sets(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("set"), made], ["set", "grams"])


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("outline_a", "outline_b", "n_a", "n_b")), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([least_different(a, b) <= most_different(n_a, n_b) for a, b, n_a, n_b in rows], pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets link."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pairs = zip(part.column("grams_a").to_pylist(), part.column("grams_b").to_pylist(), strict=True)
            yield part.select(["a", "b"]).filter(pa.array([linked(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)) for a, b in pairs], pa.bool_()))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= SHARE * (len(a) + len(b) - common)


class Join:
    """The links of the sets of a table."""

    def __init__(self, documents: DataFrame, paired: int = PAIRED):
        self.spark, self.run, self.paired = documents.sparkSession, Run(documents.sparkSession, "ngramjoin"), paired
        self.rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = self.rows.withColumn("text_key", row_key(F.col("text")))
        frequency = self.spark.sparkContext.broadcast(frequencies(self.rows))
        self.signed = self.run.land(self.rows.select("doc_id", "text_key", "text").mapInArrow(_signed(frequency), SIGNED), "signed")
        kept = ("text_key", "n", "prefix", "outline")
        sets = self.signed.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.any_value(F.struct(*kept)).alias("of"))
        sets = sets.select("set_key", "first", *(f"of.{c}" for c in kept)).withColumn("set", F.monotonically_increasing_id())
        self.sets = self.run.land(sets, "sets")

    def links(self) -> DataFrame:
        """Links (a, b) between sets that lead to all components."""
        self._share()
        pairs = self.run.land(self._filtered(self._paired().unionAll(self._with_heads())), "pairs")
        grams = self.run.land(self._grams(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "set"), "wanted"), "grams")
        first = pairs.join(grams.withColumnsRenamed({"set": "a", "grams": "grams_a"}), "a")
        both = first.join(grams.withColumnsRenamed({"set": "b", "grams": "grams_b"}), "b")
        links = self.run.land(both.select("a", "b", "grams_a", "grams_b").mapInArrow(_verify, "a long, b long"), "links")
        more = self.run.land(self._rest(components(links, self.run, "first")), "rest")
        return links.unionAll(more)

    def _share(self) -> None:
        """Prefix n-grams of at least two sets with their sets, and the heads of those of more than ``paired``."""
        grams = self.sets.select("set", "n", F.posexplode("prefix").alias("place", "gram"))
        held = self.run.land(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
        self.shared = self.run.land(grams.join(held, "gram"), "shared")
        crowded = self.shared.where(F.col("held") > self.paired)
        mass = self.run.land(crowded.groupBy("set").agg(F.sum("held").alias("mass")), "mass")
        heads = crowded.join(mass, "set").groupBy("gram").agg(F.max(F.struct("mass", "set", "n", "place")).alias("head"))
        heads = heads.select("gram", F.col("head.set").alias("head"), F.col("head.n").alias("head_n"), F.col("head.place").alias("head_place"))
        heads = self.run.land(heads, "heads")
        self.crowded = self.run.land(crowded.join(heads, "gram").where("set != head"), "crowded")

    def _paired(self) -> DataFrame:
        """All pairs of the sets of an n-gram that few sets hold: at most ``paired`` rows a row."""
        few = self.shared.where(F.col("held") <= self.paired)
        left = few.select("gram", F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"))
        right = few.select("gram", F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"))
        return left.join(right, "gram").where("a < b").drop("gram")

    def _with_heads(self) -> DataFrame:
        sides = F.struct(F.col("set").alias("s"), F.col("n").alias("n"), F.col("place").alias("p")), F.struct(F.col("head").alias("s"), F.col("head_n").alias("n"), F.col("head_place").alias("p"))
        low, high = (F.when((F.col("set") < F.col("head")) == flag, sides[0]).otherwise(sides[1]) for flag in (True, False))
        rows = self.crowded.select(low.alias("x"), high.alias("y"))
        names = [F.col(f"{x}.{c}").alias(f"{name}{end}") for x, end in (("x", "a"), ("y", "b")) for c, name in (("s", ""), ("n", "n_"), ("p", "place_"))]
        return rows.select(*names)

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), each once, that pass the length, positional and suffix filters."""
        n_a, n_b, place_a, place_b = (F.col(c) for c in ("n_a", "n_b", "place_a", "place_b"))
        pairs = pairs.where(100 * F.least(n_a, n_b) >= SHARE * F.greatest(n_a, n_b))
        fewest = F.call_function("div", SHARE * (n_a + n_b) + 99 + SHARE, F.lit(100 + SHARE))
        # At most what stands before the n-gram in both, the n-gram, and what is left behind it.
        most = F.least(place_a, place_b) + 1 + F.least(n_a - place_a - 1, n_b - place_b - 1)
        pairs = pairs.where(most >= fewest).select("a", "b").distinct()
        outlines = lambda x: self.sets.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("outline").alias(f"outline_{x}"))
        return pairs.join(outlines("a"), "a").join(outlines("b"), "b").mapInArrow(_suffix_filter, "a long, b long")

    def _grams(self, needed: DataFrame, name: str) -> DataFrame:
        """set and its n-grams, from the text of one of its rows.

        At most 2**PREFIX_BITS prefixes of keys go to the scan, so that texts that nothing asks for are dropped before the shuffle.
        """
        short = F.conv(F.substring(F.hex("text_key"), 1, PREFIX_BITS // 4), 16, 10).cast("int")
        wanted = self.run.land(self.sets.select("set", "text_key").join(needed, "set"), name)
        rows = self.rows.select("text_key", "text").withColumn("__short", short)
        rows = rows.join(F.broadcast(wanted.select(short.alias("__short")).distinct()), "__short", "left_semi").drop("__short")
        texts = rows.groupBy("text_key").agg(F.any_value("text").alias("text")).join(wanted, "text_key")
        return texts.select("set", "text").mapInArrow(_gram_bytes, "set long, grams binary")

    def _rest(self, roots: DataFrame) -> DataFrame:
        """Links between components among the sets of one head: outlines tell which sets can have any, then their n-grams decide."""
        roots = roots.select(F.col("node").alias("set"), "root")
        members = self.crowded.select("head", "set", "n").distinct().join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        members = self.run.land(members, "members")
        near = self._units(members, self.sets.select("set", F.col("outline").alias("body")), "near").mapInArrow(_near_units, "head long, set long")
        near = self.run.land(members.join(near.distinct(), ["head", "set"]), "near")
        grams = self.run.land(self._grams(near.select("set").distinct(), "near-wanted"), "near-grams")
        return self._units(near, grams.withColumnRenamed("grams", "body"), "open").mapInArrow(_link_units, "a long, b long").distinct()

    def _units(self, members: DataFrame, bodies: DataFrame, name: str) -> DataFrame:
        """The sets of heads with several components as rows (head, low, high, set, root, n, body), in order of their unit of work."""
        sums = members.groupBy("head").agg(
            F.min("root").alias("__least"), F.max("root").alias("__most"), F.sum("n").alias("grams_held"), F.count(F.lit(1)).alias("sets_held")
        )
        blocks = F.greatest(F.ceil(F.col("grams_held") / BLOCK_GRAMS), F.ceil(F.col("sets_held") / BLOCK_SETS)).cast("int").alias("blocks")
        heads = self.run.land(sums.where("__least != __most").select("head", blocks), f"{name}-heads")
        opened = members.join(heads, "head").join(bodies, "set").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        rows = opened.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("head", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set", "root", "n", "body")
        unit = F.xxhash64("head", "low", "high")
        return rows.withColumn("unit", unit).repartition("unit").sortWithinPartitions("unit", "head", "low", "high", "set").drop("unit")


def _runs(batches: Iterator[pa.RecordBatch], work, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What ``work`` finds in the rows of each unit, two blocks of one head, as pairs of numbers."""
    held: list[tuple] = []

    def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names)

    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                found += work(held)
                held = []
            held.append(row)
        yield made(found)
    if held:
        yield made(work(held))


def _near_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _runs(batches, near_sets, ["head", "set"])


def _link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _runs(batches, unit_links, ["a", "b"])


def near_pairs(roots: list, sizes: list[int], outlines: list[bytes]) -> np.ndarray:
    """Which pairs of sets of different components pass the length filter and the suffix filter, at twice as many ranges from step to step."""
    root, size = np.unique(roots, return_inverse=True)[1], np.array(sizes)
    near = (100 * np.minimum(size[:, None], size) >= SHARE * np.maximum(size[:, None], size)) & (root[:, None] != root)
    counts = [np.frombuffer(o, dtype=np.uint8).astype(np.int32) for o in outlines]
    ranges = RANGES
    while True:
        rows = np.array([r for r in np.flatnonzero(near.any(axis=1)) if len(counts[r]) >= ranges], dtype=np.int64)
        if len(rows) < 2:
            return near
        folded = np.stack([counts[r].reshape(-1, ranges).sum(axis=0) for r in rows])
        different = np.zeros((len(rows), len(rows)), dtype=np.int32)
        for place in range(ranges):
            different += np.abs(folded[:, place, None] - folded[:, place])
        near[np.ix_(rows, rows)] &= different <= most_different(size[rows][:, None], size[rows])
        ranges *= 2


def near_sets(rows: list[tuple]) -> list[tuple[int, int]]:
    """head and set of the rows of a unit (.., set, root, n, outline) that may link to another one."""
    near = near_pairs([r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows]).any(axis=1)
    return [(rows[r][0], rows[r][3]) for r in np.flatnonzero(near)]


def unit_links(rows: list[tuple]) -> list[tuple[int, int]]:
    """Links between different components of one unit's rows (.., set, root, n, n-grams) that join what any link of the unit joins."""
    roots = np.unique([r[4] for r in rows], return_inverse=True)[1]
    sets = [np.frombuffer(r[6], dtype=np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    near = near_pairs(roots, sizes, [outline(s) for s in sets])
    open_rows = np.flatnonzero(near.any(axis=1))
    if not len(open_rows):
        return []
    near = near[np.ix_(open_rows, open_rows)]
    common = common_counts([sets[r] for r in open_rows])
    union = sizes[open_rows][:, None] + sizes[open_rows] - common
    left, right = np.nonzero(np.triu(near & (100 * common >= SHARE * union)))
    # One link a step of a union of components.
    parent = list(range(roots.max() + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for x, y in zip(open_rows[left].tolist(), open_rows[right].tolist(), strict=True):
        a, b = find(roots[x]), find(roots[y])
        if a != b:
            parent[a] = b
            found.append((rows[x][3], rows[y][3]))
    return found


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets shares, by products of 0-1 matrices over the elements of at least two sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = (np.cumsum(times > 1) - 1)[place]
    shared = times[place] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common, wide = np.zeros((len(sets), len(sets)), dtype=np.int64), 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        here = slice(*np.searchsorted(column, [start, start + wide]))
        ones = np.zeros((len(sets), wide), dtype=np.float32)
        ones[owner[here], column[here] - start] = 1
        common += (ones @ ones.T).astype(np.int64)
    return common


def join(documents: DataFrame, paired: int = PAIRED) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    work = Join(documents, paired)
    links = work.run.land(work.links(), "all-links")
    roots = components(links, work.run, "all").select(F.col("node").alias("set"), "root")
    placed = work.sets.select("set", "set_key", "first").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    placed = work.run.land(placed, "placed")
    named = work.run.land(placed.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    placed = work.run.land(placed.join(named, "root").select("set_key", "component_id"), "components")
    filled = work.signed.where("n > 0").select("doc_id", "n", "set_key").join(placed, "set_key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return filled.unionAll(work.signed.where("n = 0").select("doc_id", "n", "doc_id"))
