"""Quality scores by compression: how much better does a text compress beside good text than beside bad text?

Two zstandard dictionaries are trained from blocks of good and of bad labelled text.  A text is cut into blocks
of ``BLOCK_BYTES``, every block is compressed with both, and the sizes are added up over the whole text:

* ``gain`` = (size with bad - size with good) / (size with bad + size with good), the normalised difference;
* ``ratio`` = size with good / bytes, which tells text that any dictionary compresses away (endless repeats).

A logistic curve over both, fitted on labelled texts that are not in the dictionaries, makes the calibrated score.

Defined cases: a null text, an empty one and one of white space only score 0.  Labels other than 0 and 1, null ids and
ids with both labels teach nothing.  Without labels of both kinds every text with content gets the share of label 1 (1 if
there is no label at all).  Repeated rows are scored each; extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import byte_slices, is_fold, smallest

BLOCK_BYTES = 1024
LEVEL = 3
DICTIONARY_BYTES = 112 << 10
#: The bounded learning sample: labelled texts of each kind for the dictionaries and for the curve, and blocks taken of one text.
DICTIONARY_TEXTS = 1500
CURVE_TEXTS = 1000
BLOCKS_PER_TEXT = 8
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """``good`` and ``bad`` are dictionaries; ``curve`` the weights over ``_basis``; ``prior`` is used without dictionaries."""

    good: bytes = b""
    bad: bytes = b""
    curve: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    prior: float = 1.0


class Scorer:
    """Sizes and scores of texts; one per task, since compressors keep state."""

    def __init__(self, model: Model):
        self.model = model
        self.coders = []
        for content in (model.good, model.bad) if model.good and model.bad else ():
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False))

    def features(self, text: str) -> tuple[float, float, float]:
        data = memoryview(text.encode("utf-8", "surrogatepass"))
        good, bad = self.coders
        with_good = with_bad = 0
        for at in range(0, len(data), BLOCK_BYTES):
            block = data[at : at + BLOCK_BYTES]
            with_good += len(good.compress(block))
            with_bad += len(bad.compress(block))
        return (with_bad - with_good) / (with_bad + with_good), with_good / len(data), float(np.log1p(len(data)))

    def score(self, text: str | None) -> float:
        if not text or text.isspace():
            return 0.0
        if not self.coders:
            return self.model.prior
        x = _basis(np.array([self.features(text)]))
        x = (x - self.model.centre) / self.model.spread
        z = float(np.clip(self.model.curve[0] + x[0] @ np.array(self.model.curve[1:]), -40, 40))
        return float(1 / (1 + np.exp(-z)))


def _basis(features: np.ndarray) -> np.ndarray:
    gain, ratio, length = features[:, 0], np.log(np.maximum(features[:, 1], 1e-4)), features[:, 2]
    gain = np.clip(gain, -0.4, 0.4)
    return np.stack([gain, ratio, ratio**2, gain * ratio, length, gain * length], axis=1)


def learn(documents: DataFrame, labels: DataFrame, held_out_fold: int | None = 0) -> Model:
    """Fit the model to labelled documents outside the held-out fold.

    Ids are sampled per label by hash; the sample, at most (DICTIONARY_TEXTS + CURVE_TEXTS) ids per label and
    BLOCKS_PER_TEXT blocks of a dictionary text, is all that comes to the driver.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out_fold is not None:
        usable = usable.where(~is_fold(F.col("doc_id"), held_out_fold))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("__most"))
    usable = usable.where(F.col("label") == F.col("__most")).select("doc_id", F.col("label").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(prior=1.0 if totals.get(1) or not totals else 0.0)

    taken = [smallest(usable.where(F.col("label") == kind), "doc_id", DICTIONARY_TEXTS + CURVE_TEXTS) for kind in (0, 1)]
    ids = taken[0].union(taken[1]).toPandas()
    ids["place"] = ids.groupby("label").cumcount()
    ids["rows"] = ids.groupby("label")["label"].transform("size")
    # Few labels are shared evenly between dictionaries and curve.
    ids["teaches"] = (ids["place"] * (DICTIONARY_TEXTS + CURVE_TEXTS) < ids["rows"] * DICTIONARY_TEXTS).astype(int)
    spark = documents.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids[["doc_id", "label", "teaches"]].astype("int64"), "doc_id long, label int, teaches int"))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")

    blocks = texts.where("teaches = 1").mapInArrow(_blocks, "label int, block binary").toPandas()
    contents = {kind: _dictionary(blocks.loc[blocks["label"] == kind, "block"].tolist()) for kind in (0, 1)}
    if not contents[0] or not contents[1]:
        return Model(prior=totals[1] / (totals[0] + totals[1]))
    model = Model(contents[1], contents[0])
    rows = texts.where("teaches = 0").mapInArrow(_measuring(model), "label int, gain double, ratio double, length double").toPandas()
    return _calibrated(model, rows, totals)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in byte_slices(batch, "text"):
            labels, blocks = [], []
            for label, text in zip(part.column("label").to_pylist(), texts, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                starts = np.arange(0, len(data), BLOCK_BYTES)
                if len(starts) > BLOCKS_PER_TEXT:
                    starts = starts[np.linspace(0, len(starts) - 1, BLOCKS_PER_TEXT).astype(int)]
                blocks += [data[at : at + BLOCK_BYTES] for at in starts]
                labels += [label] * len(starts)
            yield pa.RecordBatch.from_pydict({"label": pa.array(labels, pa.int32()), "block": pa.array(blocks, pa.binary())})


def _dictionary(blocks: list[bytes]) -> bytes:
    """Trained where there are samples enough, else the samples themselves."""
    blocks = sorted(b for b in blocks if len(b) >= 8)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def _measuring(model: Model):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                rows = [(label, *scorer.features(t)) for label, t in zip(part.column("label").to_pylist(), texts, strict=True) if t and not t.isspace()]
                names = ("label", "gain", "ratio", "length")
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "label" else pa.float64()) for n, c in zip(names, columns, strict=True)], names)

    return measure


def _calibrated(model: Model, rows, totals: dict[int, int]) -> Model:
    """Logistic regression by Newton steps, every label weighted to its share among all labels."""
    rows = rows.sort_values(["label", "gain", "ratio", "length"])
    label = rows["label"].to_numpy(float)
    if not len(label) or label.min() == label.max():
        return Model(prior=totals[1] / (totals[0] + totals[1]))
    x = _basis(rows[["gain", "ratio", "length"]].to_numpy(float))
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    weight = np.where(label == 1, totals[1] / label.sum(), totals[0] / (1 - label).sum())
    weight *= len(label) / weight.sum()
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - label)) + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.good, model.bad, tuple(w.tolist()), tuple(centre.tolist()), tuple(spread.tolist()), 1.0)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""
    content = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(content.value)
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                scores = [scorer.score(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                    ["doc_id", "score", "predicted"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is predicted good, all columns as they are."""
    content = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(content.value)
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                yield part.filter(pa.array([scorer.score(t) >= THRESHOLD for t in texts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
