"""Log probabilities of texts by deleted interpolation.

The probability of a token w after v mixes maximum-likelihood estimates of decreasing order,

    p(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1),

with weights l2 + l1 + l0 = 1 of their own for every bucket of context frequencies, ``floor(log2 c(v))``.  The weights are learned by
expectation-maximisation: training documents are split in two, estimates come from one part, and the weights are fitted to the
held-out counts of the other.  Final estimates use both.  With ``order`` 3 a trigram term is added; its buckets follow the longest context seen.

Exact counts of all n-grams, in bounded memory and without a row per n-gram:

1. A task hashes the words of a block of documents (about BLOCK_BYTES), and sorts its distinct n-grams.  For each range of hashes it
   sends one row: the sorted hashes as packed differences, and how often each occurs in either part.  A word that makes up a third of the
   corpus is one entry per block.
2. A task per range merges the sorted runs, adds up, and answers every block with the totals in the block's own order, so that no hash
   travels back.
3. The block's documents are read again, met with the answers by block id, and scored.  A block id is a hash of its documents; a block that finds no answer
   stops the job, since the input then changed between two reads.

Ranges are as many as keep RANGE_GRAMS n-grams in one.  For the weights, held-out tokens are counted in bins of half a power of two per estimate (a whole one for single words); EM runs over these
counts on the driver, whose number the bins bound, not the corpus.

Tokens: A-Z in lower case, words are runs of other bytes than space and 0x09-0x0D, then one end token.  Defined cases: a null text is empty and has the end
token only.  Repeated rows count and are scored each.  Without training tokens estimates are 0 and every token has the probability 1 / (V + 1) = 1.
Words are told apart by 64-bit hashes, longer n-grams by GRAM_BITS.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Run, byte_slices, is_fold
from tracemill.llm.hashing import mix, word_hashes

ORDER = 3
EVALUATED_FOLD = 1  # never learned from
DELETED_FOLD = 2  # the part that the weights are fitted to
BLOCK_BYTES = 3 << 20
GRAM_BITS = 56  # of the hashes of n-grams with several words; words have 64
RANGE_GRAMS = 1 << 20
BYTES_PER_TOKEN = 6
BUCKETS = 40
EM_ROUNDS = 200
#: Steps per power of two of the estimates, single words first: coarse enough that a few ten thousand bins hold all held-out tokens.
BIN_STEPS = (1, 2, 2, 2, 2, 2, 2, 2)
LEAST_WEIGHT = 1e-7

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[32, *range(9, 14)]] = False
_PLACES = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
START, END = (mix(np.array([n], dtype=np.uint64))[0] for n in (0x53746172, 0x456E64))

BLOCK_SCHEMA = "block binary, deleted boolean, ids binary, sizes binary, texts binary"
COUNT_SCHEMA = "part int, size int, block binary, hashes binary, kept binary, deleted binary"
ANSWER_SCHEMA = "block binary, part int, size int, kept binary, deleted binary, kept_tokens long, deleted_tokens long, kept_words long, words long, kept_starts long, starts long"
SCORE_SCHEMA = "doc_id long, evaluated boolean, n_tokens long, n_known long, base_score double, score double"
BIN_SCHEMA = "bucket int, bins binary, n long"


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed: high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


@dataclass
class Block:
    """The n-grams of some texts: hashes per order of every token, aligned; ``owner`` tells the text of a token."""

    grams: list[np.ndarray]
    owner: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], order: int) -> Block:
        words, bounds = word_hashes([t.lower() for t in texts], _WORD_BYTE)
        lengths = np.diff(bounds) + 1
        last = np.cumsum(lengths) - 1
        tokens = np.empty(len(words) + len(texts), dtype=np.uint64)
        is_end = np.zeros(len(tokens), dtype=bool)
        is_end[last] = True
        tokens[is_end], tokens[~is_end] = END, words
        first = last - lengths + 1
        grams, previous = [tokens], tokens
        running = tokens * _PLACES[0]
        for distance in range(1, order):
            previous = np.roll(previous, 1)
            previous[first] = START
            running = running + previous * _PLACES[distance]
            grams.append(mix(running + np.uint64(distance)) >> np.uint64(64 - GRAM_BITS))
        return cls(grams, np.repeat(np.arange(len(texts)), lengths), lengths)

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-grams and the place of each token's n-gram among them; order 1 holds the start of texts as well."""
        grams = self.grams[order - 1]
        if order == 1:
            grams = np.append(grams, START)
        return np.unique(grams, return_inverse=True)


def _blocks(batches: Iterator[pa.RecordBatch], only_deleted: bool = False) -> Iterator[tuple[bytes, bool, np.ndarray, np.ndarray, list[bytes]]]:
    """(id, which begins with whether it is deleted; that; doc ids, whether each is evaluated, texts); documents of the deleted part have blocks of their own.

    Blocks end where Arrow batches end, so every pass has to read all rows: a filter before it would cut others.
    """
    for batch in batches:
        for deleted in (True,) if only_deleted else (False, True):
            part = batch.filter(pa.compute.equal(batch.column("deleted"), deleted))
            for piece, texts in byte_slices(part, "text", BLOCK_BYTES):
                encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
                ids = piece.column("doc_id").fill_null(-(1 << 63)).to_numpy()
                evaluated = piece.column("evaluated").to_numpy(zero_copy_only=False)
                state = blake2b(ids.tobytes(), digest_size=16)
                for text in encoded:
                    state.update(len(text).to_bytes(8, "little"))
                    state.update(text)
                yield bytes([deleted]) + state.digest(), deleted, ids, evaluated, encoded


def _counting(order: int, part_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, deleted, _, evaluated, texts in _blocks(batches):
            block = Block.of(texts, order)
            learned = ~evaluated[block.owner]
            for size in range(1, order + 1):
                grams, place = block.distinct(size)
                # The start of a text is no token: its count is the number of texts that are learned from.
                weight = np.append(learned, 0) if size == 1 else learned
                counts = np.bincount(place, weights=weight, minlength=len(grams)).astype(np.uint32)
                if size == 1:
                    counts[np.searchsorted(grams, START)] = (~evaluated).sum()
                parts = (grams >> np.uint64((64 if size == 1 else GRAM_BITS) - part_bits)).astype(np.int64) if part_bits else np.zeros(len(grams), dtype=np.int64)
                cuts = np.flatnonzero(np.diff(parts)) + 1
                rows = []
                for first, last in zip([0, *cuts], [*cuts, len(grams)], strict=True):
                    hashes = pack(np.diff(grams[first:last], prepend=np.uint64(0)))
                    here, none = pack(counts[first:last]), pack(np.zeros(last - first, dtype=np.uint32))
                    rows.append((int(parts[first]), size, key, hashes, *((none, here) if deleted else (here, none))))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in COUNT_SCHEMA.split(", ")])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Totals of one range of hashes, for every block in its own order; one row without a block holds the sums."""
    out = []
    sizes = group.column("size").to_numpy()
    part = group.column("part")[0].as_py()
    sums = dict.fromkeys(("kept_tokens", "deleted_tokens", "kept_words", "words", "kept_starts", "starts"), 0)
    for size in np.unique(sizes):
        rows = group.filter(pa.array(sizes == size))
        runs = [np.cumsum(unpack(h, np.uint64)) for h in rows.column("hashes").to_pylist()]
        grams, place = np.unique(np.concatenate(runs), return_inverse=True)
        totals = []
        for name in ("kept", "deleted"):
            counts = np.concatenate([unpack(c, np.uint32) for c in rows.column(name).to_pylist()])
            totals.append(np.bincount(place, weights=counts, minlength=len(grams)).astype(np.uint64))
        if size == 1:
            word = grams != START
            kept, deleted = totals
            sums["kept_tokens"], sums["deleted_tokens"] = int(kept[word].sum()), int(deleted[word].sum())
            sums["kept_words"], sums["words"] = int((kept[word] > 0).sum()), int((kept[word] + deleted[word] > 0).sum())
            sums["kept_starts"], sums["starts"] = int(kept[~word].sum()), int((kept + deleted)[~word].sum())
        ends = np.cumsum([len(r) for r in runs])
        for key, first, last in zip(rows.column("block").to_pylist(), ends - [len(r) for r in runs], ends, strict=True):
            here = place[first:last]
            out.append({"block": key, "part": part, "size": int(size), "kept": pack(totals[0][here]), "deleted": pack(totals[1][here])})
    out.append({"part": part, **sums})
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    return pa.Table.from_pylist(out, schema=pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ANSWER_SCHEMA.split(", "))]))


def _payload(only_deleted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, deleted, ids, evaluated, texts in _blocks(batches, only_deleted):
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            columns = ([key], [deleted], [pack(np.stack([ids, evaluated.astype(np.int64)]).ravel())], [pack(sizes)], [packed])
            kinds = (pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    return run


def _open(payload: pa.Table, row: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    both = unpack(payload.column("ids")[row].as_py(), np.int64).reshape(2, -1)
    sizes = unpack(payload.column("sizes")[row].as_py(), np.int64)
    data = zstandard.ZstdDecompressor().decompress(payload.column("texts")[row].as_py())
    ends = np.cumsum(sizes)
    return both[0], both[1].astype(bool), [data[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def _counts(block: Block, answers: pa.Table, order: int, both: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order: the count of each token's n-gram, and of its context."""
    found: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    for size, part, kept, deleted in zip(*(answers.column(n).to_pylist() for n in ("size", "part", "kept", "deleted")), strict=True):
        found.setdefault((size, part), (kept, deleted))
    totals, places, grams = [], [], []
    for size in range(1, order + 1):
        distinct, place = block.distinct(size)
        pieces = [found[k] for k in sorted(found) if k[0] == size]
        counts = np.concatenate([unpack(k, np.uint64) + (unpack(d, np.uint64) if both else 0) for k, d in pieces]) if pieces else np.empty(0)
        if len(counts) != len(distinct):
            raise RuntimeError("a block of documents was counted with other texts: the input changed between two reads")
        totals.append(counts.astype(np.float64))
        places.append(place[: len(block.owner)])
        grams.append(distinct)
    own = [t[p] for t, p in zip(totals, places, strict=True)]
    last = np.cumsum(block.lengths) - 1
    first = last - block.lengths + 1
    contexts: list[np.ndarray] = [np.empty(0)]
    before = totals[0][np.searchsorted(grams[0], START)]
    for size in range(2, order + 1):
        # The context of a token is the n-gram, one shorter, that ends before it; a text of many tokens has its start once.
        shifted = np.roll(own[size - 2], 1)
        shifted[first] = before
        contexts.append(shifted)
    return own, contexts


def estimates(own: list[np.ndarray], contexts: list[np.ndarray], tokens: float, words: float) -> tuple[np.ndarray, np.ndarray]:
    """(order + 1, n) estimates, the uniform one first, and the bucket of each token."""
    rows = [np.full(len(own[0]), 1 / (words + 1)), own[0] / max(tokens, 1)]
    rows += [o / np.maximum(c, 1) for o, c in zip(own[1:], contexts[1:], strict=True)]
    bucket = np.zeros(len(own[0]), dtype=np.int64)
    for size in range(1, len(contexts)):
        seen = contexts[size] > 0
        level = np.floor(np.log2(np.maximum(contexts[size], 1))).astype(np.int64)
        bucket = np.where(seen, 1 + (size - 1) * BUCKETS + np.minimum(level, BUCKETS - 1), bucket)
    return np.stack(rows), bucket


def _binning(order: int, tokens: float, words: float):
    def run(payload: pa.Table, answers: pa.Table) -> pa.Table:
        rows = {"bucket": [], "bins": [], "n": []}
        for row in range(payload.num_rows):
            _, _, texts = _open(payload, row)
            block = Block.of(texts, order)
            p, bucket = estimates(*_counts(block, answers, order, both=False), tokens, words)
            # 0 stands for an estimate of 0, else the bin counts down from 1.
            steps = np.array(BIN_STEPS[:order])[:, None]
            bins = np.where(p[1:] > 0, 1 + np.rint(-steps * np.log2(np.maximum(p[1:], 1e-300))), 0).astype(np.int16)
            keys, n = np.unique(np.vstack([bucket.astype(np.int16), bins]), axis=1, return_counts=True)
            rows["bucket"] += keys[0].tolist()
            rows["bins"] += [k.tobytes() for k in np.ascontiguousarray(keys[1:].T)]
            rows["n"] += n.tolist()
        return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("bins", pa.binary()), ("n", pa.int64())]))

    return run


def fit_weights(p: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mixture weights (buckets, orders) by EM; a bucket without held-out tokens takes those of all buckets together."""
    orders = len(p)

    def em(p: np.ndarray, n: np.ndarray, begin: np.ndarray) -> np.ndarray:
        w = begin
        for _ in range(EM_ROUNDS):
            share = w[:, None] * p
            share /= np.maximum(share.sum(axis=0), 1e-300)
            now = (share * n).sum(axis=1)
            now = np.maximum(now / now.sum(), LEAST_WEIGHT)
            now /= now.sum()
            if np.abs(now - w).max() < 1e-9:
                return now
            w = now
        return w

    table = np.full((1 + BUCKETS * max(1, orders - 2), orders), 1 / orders)
    if not len(n):
        return table
    table[:] = em(p, n, np.full(orders, 1 / orders))
    for b in np.unique(bucket):
        here = bucket == b
        table[b] = em(p[:, here], n[here], np.full(orders, 1 / orders))
    return table


def _scoring(order: int, tokens: float, words: float, weights):
    def run(payload: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in range(payload.num_rows):
            ids, evaluated, texts = _open(payload, row)
            block = Block.of(texts, order)
            own, contexts = _counts(block, answers, order, both=True)
            p, bucket = estimates(own, contexts, tokens, words)
            mixed = (weights.value[bucket].T * p).sum(axis=0) if tokens else np.ones(len(bucket))
            base = np.log10((own[0] + 0.5) / (tokens + 0.5 * (words + 1)))
            first = np.cumsum(block.lengths) - block.lengths
            total = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has an end token, so no text is empty here
            columns = (
                pa.array(ids, mask=ids == -(1 << 63)), pa.array(evaluated), pa.array(block.lengths.astype(np.int64)),
                pa.array(total((own[0] > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(np.log10(mixed))),
            )
            out.append(pa.Table.from_arrays(list(columns), names=[c.split()[0] for c in SCORE_SCHEMA.split(", ")]))
        if out:
            return pa.concat_tables(out)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.schema(list(zip([c.split()[0] for c in SCORE_SCHEMA.split(", ")], kinds, strict=True))).empty_table()

    return run


def score(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark, run = documents.sparkSession, Run(documents.sparkSession, "langmodel")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        is_fold(F.col("doc_id"), EVALUATED_FOLD).alias("evaluated"),
        is_fold(F.col("doc_id"), DELETED_FOLD).alias("deleted"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, order * size // BYTES_PER_TOKEN // RANGE_GRAMS)
    counts = rows.mapInArrow(_counting(order, (ranges - 1).bit_length()), COUNT_SCHEMA)
    answers = run.land(counts.groupBy("part").applyInArrow(_answer, ANSWER_SCHEMA), "answers")
    sums = answers.where(F.col("block").isNull()).agg(*[F.sum(c).alias(c) for c in ("kept_tokens", "deleted_tokens", "kept_words", "words")]).first()
    kept_tokens, kept_words, words = sums["kept_tokens"] or 0, sums["kept_words"] or 0, sums["words"] or 0
    tokens = kept_tokens + (sums["deleted_tokens"] or 0)
    answers = answers.where(F.col("block").isNotNull()).select("block", "part", "size", "kept", "deleted")

    held = rows.mapInArrow(_payload(True), BLOCK_SCHEMA).groupBy("block")
    held_answers = answers.where(F.substring("block", 1, 1) == F.lit(bytes([1]))).groupBy("block")
    bins = held.cogroup(held_answers).applyInArrow(_binning(order, kept_tokens, kept_words), BIN_SCHEMA)
    found = bins.groupBy("bucket", "bins").agg(F.sum("n").alias("n")).toPandas()
    weights = spark.sparkContext.broadcast(_weights(found, order, kept_words))

    blocks = rows.mapInArrow(_payload(False), BLOCK_SCHEMA).groupBy("block")
    scores = blocks.cogroup(answers.groupBy("block")).applyInArrow(_scoring(order, tokens, words, weights), SCORE_SCHEMA)
    return scores.select(
        "doc_id", F.col("evaluated").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _weights(found, order: int, words: float) -> np.ndarray:
    found = found.sort_values(["bucket", "bins"])
    bins = np.stack([np.frombuffer(bytes(b), dtype=np.int16) for b in found["bins"]]) if len(found) else np.empty((0, order), np.int16)
    p = np.where(bins > 0, 2.0 ** (-(bins - 1) / np.array(BIN_STEPS[:order])), 0.0)
    p = np.vstack([np.full(len(found), 1 / (words + 1)), p.T]) if len(found) else np.empty((order + 1, 0))
    return fit_weights(p, found["bucket"].to_numpy(), found["n"].to_numpy(float))
