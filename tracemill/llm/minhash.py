"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is its set of runs of WORDS words (letters and digits, lower case) with weights ``(1 + ln tf) * idf``.  Two texts are linked
if the weighted Jaccard similarity of these sets is at least SIMILARITY; classes are the connected components of all links.

1. *Document frequencies* of all shingles are counted in a table of 2**SKETCH_BITS cells by hash, of fixed size for any corpus.
   ``idf = 1 + ln(3 N / (df + 2 N))``: smoothed by twice the number of documents N, since a text with thousands of near copies would
   else lose weight through its own copies, and what sets the copies apart would break the links.
2. *Samples.*  For each of BANDS * BAND_ROWS functions every shingle draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash and
   ``t = floor(ln w / r + b)``, ``ln a = ln c - r (t - b) - r``; the smallest ``ln a`` of the text is its sample.  Two texts
   agree in a sample with the probability of their similarity.  Draws come from tables (256 steps for r and b, 65536 for c) and
   ln w in steps of 1/8, so that a draw costs one multiplication and two lookups; links are verified with exact weights.
3. *Bands.*  Equal texts count once.  BAND_ROWS samples make a bucket key.  The head of a bucket is its text whose buckets hold the
   most texts: in a family of copies, the text they were made from or one close to it.
4. *Verification.*  Every text is compared with the heads of its buckets over the whole texts; the comparison also keeps the
   difference of both sets.
5. *Rest.*  Two texts that met in a bucket but are not yet in one class are both in the group of that bucket's head.  Such groups
   are cut into blocks of BLOCK_TEXTS, and every pair of blocks is one unit of work: from the differences to the head the exact
   similarity of all pairs follows by one matrix product, and each unit returns no more links than it has texts.

So every pair that shares a bucket is either compared exactly or already in one class; a pair at similarity s shares none with
probability (1 - s**BAND_ROWS)**BANDS, 0.2 % at s = 0.8.

Defined cases: null counts as the empty text.  Equal texts, empty ones too, are one class.  Texts of 1 to 4 words have one
shingle, all their words; texts without words have none and are linked to equal texts only.  The class id is the smallest doc_id of the class (null
if it has none).  Repeated rows and rows that share a doc_id are rows of their own.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import hashing
from tracemill.llm.common import Run, byte_slices
from tracemill.llm.graph import components
from tracemill.llm.hashing import mix

WORDS = 5
SIMILARITY = 0.8
BANDS = 16
BAND_ROWS = 5
SKETCH_BITS = 17
PREFIX_BITS = 20
BLOCK_TEXTS = 512
SEED = 20240229
SAMPLES = BANDS * BAND_ROWS
LEVEL_STEP = 0.125
LEVELS = 28
ROWS_AT_ONCE = 1024

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in lower case, and where the words of each text begin (one entry more)."""
    return hashing.word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts], _WORD_BYTE)


_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def shingle_sets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text and how often each occurs."""
    words, bounds = word_hashes(texts)
    count = max(0, len(words) - WORDS + 1)
    runs = np.zeros(count, dtype=np.uint64)
    for place in range(WORDS):
        runs += words[place : place + count] * _PLACES[place]
    runs = mix(runs)
    for at in range(len(texts)):
        first, last = bounds[at], bounds[at + 1]
        if last - first >= WORDS:
            yield np.unique(runs[first : last - WORDS + 1], return_counts=True)
        elif last > first:
            few = words[first:last] * _PLACES[: last - first]
            yield mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(last - first)), np.ones(1, dtype=np.int64)
        else:
            yield np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def document_frequencies(documents: DataFrame) -> np.ndarray:
    """idf of every cell of the frequency table, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for _, texts in byte_slices(batch, "text"):
                sets = [hashes for hashes, _ in shingle_sets([t or "" for t in texts])]
                table += np.bincount(cell(np.concatenate(sets)), minlength=len(table))
        used = np.flatnonzero(table)
        cells, counts = np.append(used, -1), np.append(table[used], rows)  # cell -1 counts the documents
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(counts, pa.int64())], ["cell", "n"])

    rows = documents.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = float(rows.loc[rows["cell"] == -1, "n"].sum())
    rows = rows[rows["cell"] >= 0]
    df = np.zeros(1 << SKETCH_BITS)
    df[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    # What rare shingles add to every cell is about the mean, and is taken off.
    df = np.clip(df - df.sum() / len(df), 1.0, max(total, 1.0))
    return 1 + np.log(3 * max(total, 1.0) / (df + 2 * max(total, 1.0)))


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(np.maximum(counts, 1))) * idf[cell(hashes)]


@lru_cache(maxsize=1)
def _gamma_quantiles(steps: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middle of each of ``steps`` equal shares, by bisection of 1 - (1 + x) exp(-x)."""
    share = (np.arange(steps) + 0.5) / steps
    low, high = np.zeros(steps), np.full(steps, 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln c by 16 bits; r (t - b) + r by weight level and 16 bits; the multiplier of each sample."""
    log_c = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
    r = np.repeat(_gamma_quantiles.__wrapped__(256), 256)
    b = np.tile((np.arange(256) + 0.5) / 256, 256)
    log_weight = (np.arange(LEVELS) * LEVEL_STEP)[:, None]
    t = np.floor(log_weight / r + b)
    multipliers = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)
    return log_c, (r * (t - b) + r).astype(np.float32).ravel(), multipliers


def signature(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SAMPLES numbers of a text with at least one shingle."""
    log_c, subtract, multipliers = _draws()
    level = np.clip(np.rint(np.log(weight) / LEVEL_STEP), 0, LEVELS - 1).astype(np.uint32) << np.uint32(16)
    least = np.full(SAMPLES, np.inf, dtype=np.float32)
    for at in range(0, len(hashes), ROWS_AT_ONCE):
        drawn = ((hashes[at : at + ROWS_AT_ONCE, None] * multipliers) >> np.uint64(32)).astype(np.uint32)
        high = drawn >> np.uint32(16)
        drawn &= np.uint32(0xFFFF)
        drawn += level[at : at + ROWS_AT_ONCE, None]
        found = np.take(log_c, high, mode="clip")
        found -= np.take(subtract, drawn, mode="clip")
        np.minimum(least, found.min(axis=0), out=least)
    return least


def features(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted set as a plain set: level t of a shingle weighs what its t-th occurrence adds.

    The weighted Jaccard similarity of two texts is then the weight of the common features over that of all.
    """
    base = idf[cell(hashes)]
    more = np.flatnonzero(counts > 1)
    if not len(more):
        return hashes, base
    extra = counts[more] - 1
    owner = np.repeat(more, extra)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(extra) - extra, extra) + 2
    ids = np.concatenate([hashes, mix(hashes[owner] + nth.astype(np.uint64) * _BASE)])
    added = np.concatenate([base, base[owner] * (np.log(nth) - np.log(nth - 1))])
    order = np.argsort(ids, kind="stable")
    return ids[order], added[order]


def text_features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return features(*next(shingle_sets([text or ""])), idf)


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 without features."""
    common = np.isin(left[0], right[0], assume_unique=True)
    both = float(left[1][common].sum())
    union = float(left[1].sum() + right[1].sum()) - both
    return both / union if union > 0 else 0.0


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


class Classes:
    """Classes of the texts of a table; ``members`` holds doc_id, text key and class of every row."""

    def __init__(self, documents: DataFrame, name: str = "neardup"):
        self.spark: SparkSession = documents.sparkSession
        self.run = Run(self.spark, name)
        self.rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.idf = self.spark.sparkContext.broadcast(document_frequencies(self.rows))  # 2**SKETCH_BITS numbers
        self.members = self._members()

    def _members(self) -> DataFrame:
        signed = self.run.land(
            self.rows.withColumn("key", text_key(F.col("text"))).mapInArrow(self._sign(), "doc_id long, key binary, samples binary"), "signed"
        )
        texts = signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.any_value("samples").alias("samples"))
        texts = self.run.land(texts, "texts")
        stars = self._stars(texts)
        verified = self.run.land(self._verify(stars), "verified")
        edges = verified.where(F.col("similar")).select(F.col("head").alias("a"), F.col("key").alias("b"))
        roots = components(edges, self.run, "star")
        rest = self.run.land(self._rest(verified, roots), "rest")
        if rest.take(1):
            roots = components(edges.union(rest), self.run, "all")
        roots = roots.select(F.col("node").alias("key"), F.col("root"))
        placed = texts.select("key", "first").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        named = placed.groupBy("root").agg(F.min("first").alias("class_id"))
        placed = placed.join(named, "root").select("key", "root", "class_id")
        return signed.select("doc_id", "key").join(placed, "key")

    def _sign(self):
        idf = self.idf

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in byte_slices(batch, "text"):
                    samples = []
                    for hashes, counts in shingle_sets([t or "" for t in texts]):
                        samples.append(signature(hashes, weights(hashes, counts, idf.value)).tobytes() if len(hashes) else None)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("key"), pa.array(samples, pa.binary())], ["doc_id", "key", "samples"]
                    )

        return sign

    def _stars(self, texts: DataFrame) -> DataFrame:
        """Distinct (head, key): every text beside the heads of its buckets."""
        bands = F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)),
            lambda band: F.xxhash64(F.substring(F.col("samples"), band * (4 * BAND_ROWS) + 1, F.lit(4 * BAND_ROWS)), band),
        )
        rows = texts.where(F.col("samples").isNotNull()).select("key", F.explode(bands).alias("bucket"))
        held = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        crowded = self.run.land(rows.join(held, "bucket"), "crowded")
        central = crowded.groupBy("key").agg(F.sum("held").alias("mass"))
        ranked = crowded.join(central, "key")
        heads = ranked.groupBy("bucket").agg(F.max(F.struct("mass", "key"))["key"].alias("head"))
        pairs = crowded.select("bucket", "key").join(heads, "bucket").where("key != head")
        return self.run.land(pairs.select("head", "key").distinct(), "stars")

    def _bodies(self, stars: DataFrame) -> DataFrame:
        """key and text of the texts in ``stars``, each once.

        A set of 2**PREFIX_BITS key prefixes at most goes to the scan, so that texts without partner are dropped before the shuffle.
        """
        prefix = F.conv(F.substring(F.hex("key"), 1, PREFIX_BITS // 4), 16, 10).cast("int")
        needed = stars.select("key").union(stars.select("head")).distinct()
        prefixes = needed.select(prefix.alias("__prefix")).distinct()
        rows = self.rows.select(text_key(F.col("text")).alias("key"), "text").withColumn("__prefix", prefix)
        rows = rows.join(F.broadcast(prefixes), "__prefix", "left_semi").drop("__prefix")
        # Copies of one text shrink to one row before they are shuffled.
        return rows.groupBy("key").agg(F.any_value("text").alias("text")).join(needed, "key", "left_semi")

    def _verify(self, stars: DataFrame) -> DataFrame:
        """similar, and the difference to the head: the features of either text alone, those of the head first."""
        bodies = self.run.land(self._bodies(stars), "bodies")
        pairs = stars.join(bodies, "key").join(bodies.select(F.col("key").alias("head"), F.col("text").alias("head_text")), "head")
        idf = self.idf

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last_key, last = None, None
            for batch in batches:
                for part, texts in byte_slices(batch, "text"):
                    out = []
                    for head, head_text, text in zip(part.column("head").to_pylist(), part.column("head_text").to_pylist(), texts, strict=True):
                        if head != last_key:
                            last_key, last = head, text_features(head_text, idf.value)
                        out.append(_difference(last, text_features(text, idf.value)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("head"),
                            part.column("key"),
                            pa.array([o[0] for o in out], pa.bool_()),
                            pa.array([o[1] for o in out], pa.float64()),
                            pa.array([o[2] for o in out], pa.int32()),
                            pa.array([o[3] for o in out], pa.binary()),
                            pa.array([o[4] for o in out], pa.binary()),
                        ],
                        ["head", "key", "similar", "head_weight", "of_head", "ids", "id_weights"],
                    )

        schema = "head binary, key binary, similar boolean, head_weight double, of_head int, ids binary, id_weights binary"
        return pairs.mapInArrow(verify, schema)

    def _rest(self, verified: DataFrame, roots: DataFrame) -> DataFrame:
        """Links (a, b) between classes among the texts of one head that are not in one class yet."""
        roots = roots.select(F.col("node").alias("key"), "root")
        rows = verified.select("head", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        groups = rows.groupBy("head").agg(F.min("root").alias("__least"), F.max("root").alias("__most"), F.count(F.lit(1)).alias("held"))
        groups = groups.where("__least != __most").select("head", F.ceil(F.col("held") / BLOCK_TEXTS).cast("int").alias("blocks"))
        rows = verified.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).join(groups, "head")
        block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        rows = rows.select("head", low, high, "key", "root", "head_weight", "of_head", "ids", "id_weights")
        rows = rows.withColumn("unit", F.xxhash64("head", "low", "high"))
        rows = rows.repartition("unit").sortWithinPartitions("unit", "head", "low", "high", "key")
        return rows.mapInArrow(_link_units, "a binary, b binary").distinct()


def _difference(head: tuple[np.ndarray, np.ndarray], text: tuple[np.ndarray, np.ndarray]):
    only_head = ~np.isin(head[0], text[0], assume_unique=True)
    only_text = ~np.isin(text[0], head[0], assume_unique=True)
    weight = float(head[1].sum())
    common = weight - float(head[1][only_head].sum())
    union = weight + float(text[1][only_text].sum())
    ids = np.concatenate([head[0][only_head], text[0][only_text]])
    added = np.concatenate([head[1][only_head], text[1][only_text]])
    return union > 0 and common / union >= SIMILARITY, weight, int(only_head.sum()), ids.tobytes(), added.tobytes()


def _link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one unit (two blocks of one head); a unit has about 2 * BLOCK_TEXTS rows."""
    names = ["head", "low", "high", "key", "root", "head_weight", "of_head", "ids", "id_weights"]
    held: list[tuple] = []
    out: list[tuple[bytes, bytes]] = []

    def made() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], ["a", "b"])
        out.clear()
        return rows

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if held and held[0][:3] != row[:3]:
                out += _links(held)
                held = []
            held.append(row)
        if out:
            yield made()
    if held:
        out += _links(held)
    yield made()


def _links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Links that join different classes within one unit, at most one fewer than it has rows.

    With h the head, D the weight of the features that both texts add to h or both take from it:
    weight(x and y) = weight(h) - taken(x) - taken(y) + D.
    """
    roots = np.unique([r[4] for r in rows], return_inverse=True)[1]
    if len(rows) < 2 or roots.max() == 0:
        return []
    ids = [np.frombuffer(r[7], dtype=np.uint64) for r in rows]
    added = [np.frombuffer(r[8], dtype=np.float64) for r in rows]
    taken = np.array([a[: r[6]].sum() for a, r in zip(added, rows, strict=True)])
    head_weight = rows[0][5]
    own = head_weight - 2 * taken + np.array([a.sum() for a in added])
    owner = np.repeat(np.arange(len(rows)), [len(i) for i in ids])
    flat, values = np.concatenate(ids), np.concatenate(added)
    distinct, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    column = np.cumsum(count > 1) - 1
    column, owner, values = column[place[shared]], owner[shared], np.sqrt(values[shared])
    meet = np.zeros((len(rows), len(rows)))
    order = np.argsort(column, kind="stable")
    column, owner, values = column[order], owner[order], values[order]
    wide = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        here = slice(*np.searchsorted(column, [start, start + wide]))
        matrix = np.zeros((len(rows), wide))
        matrix[owner[here], column[here] - start] = values[here]
        meet += matrix @ matrix.T
    common = head_weight - taken[:, None] - taken[None, :] + meet
    union = own[:, None] + own[None, :] - common
    near = common >= SIMILARITY * union - 1e-9
    # Walk over classes: every step takes all texts linked to what was reached and their classmates, and notes one link each.
    found, seen = [], np.zeros(len(rows), dtype=bool)
    mates = roots[:, None] == roots[None, :]
    for first in range(len(rows)):
        if seen[first]:
            continue
        front = mates[first] & ~seen
        seen |= front
        while front.any():
            at = np.flatnonzero(front)
            touched = near[at].any(axis=0) & ~seen
            fresh = np.flatnonzero(touched)
            if not len(fresh):
                break
            # One link into each class newly reached.
            _, firsts = np.unique(roots[fresh], return_index=True)
            for y in fresh[firsts]:
                x = at[near[at, y].argmax()]
                found.append((rows[x][3], rows[y][3]))
            front = mates[fresh].any(axis=0) & ~seen
            seen |= front
    return found


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id and is_first of every row."""
    members = Classes(documents).members
    return members.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_first"))


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each class, all columns as they are: that with the smallest doc_id (rows without one come last), then key."""
    from pyspark.sql import Window

    members = Classes(documents).members
    chosen = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("kept"))
    chosen = chosen.select(F.coalesce(F.col("kept.doc_id"), F.lit(-1)).alias("__id"), F.col("kept.key").alias("__key"), F.col("kept.none").alias("__none"))
    rows = documents.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__key": text_key(F.col("text").cast("string")), "__none": F.col("doc_id").isNull()}
    )
    once = F.row_number().over(Window.partitionBy("__id", "__key", "__none").orderBy(F.lit(0)))
    kept = rows.join(chosen, ["__id", "__key", "__none"]).withColumn("__nth", once).where("__nth = 1")
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
