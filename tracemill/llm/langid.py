"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads segments of ``STEPS`` bytes, one state left to right and one right to left, and labels every position;
the probabilities of all letter positions of a document are averaged.  It is trained here in numpy: position-wise
cross-entropy, gradients by backpropagation through time, Adam steps.  All segments of a slice run side by side, so one
step of the recurrence is a few matrix operations over thousands of segments.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if no language could be
learned.  With one known language every text with a letter gets it.  Repeated rows are predicted each; ties between
languages go to the first in sorted order; extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import byte_slices, is_fold, smallest

UNKNOWN = "und"
HIDDEN = 8
STEPS = 96
PAD = 256  # a position behind the end of a text: leaves the state as it is
#: The bounded learning sample: documents per language and segments of one document.
TEXTS_PER_LANGUAGE = 400
SEGMENTS_PER_TEXT = 3
EPOCHS = 8
MINIBATCH = 128
RATE = 0.02
SEED = 7
SEGMENTS_AT_ONCE = 1024
#: The pipeline rejects documents without a language and those whose best language stays below this.
LEAST_SCORE = 0.3

#: Letters: ASCII letters and all bytes of longer UTF-8 sequences.
LETTER = np.zeros(257, dtype=np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass(frozen=True)
class Network:
    """Gates are stacked as update, reset, candidate.  ``embed`` (2, 3H, 257), ``recur`` (2, 3H, H), ``bias`` (2, H, 1) of the
    candidate's recurrent part, ``out`` (L, 2H), ``out_bias`` (L, 1); the first axis is the direction."""

    languages: tuple[str, ...] = ()
    embed: np.ndarray | None = None
    recur: np.ndarray | None = None
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None


def _softsign(x: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the network's squashing curve, several times cheaper than tanh here."""
    np.abs(x, out=scratch)
    scratch += 1
    return np.divide(x, scratch, out=x)


def _run(net: Network, segments: np.ndarray, direction: int, keep: bool = False):
    """States (T, H, N) of one direction over segments (T, N); with ``keep`` also the gates of every step.

    Gates are (1 + softsign) / 2, the candidate is softsign.
    """
    hidden = net.recur.shape[2]
    steps, count = segments.shape
    embed, recur, bias = net.embed[direction], net.recur[direction], net.bias[direction]
    states = np.empty((steps, hidden, count), dtype=np.float32)
    kept = {} if keep else None
    state = np.zeros((hidden, count), dtype=np.float32)
    scratch, gates, pulled = (np.empty((3 * hidden, count), dtype=np.float32) for _ in range(3))
    for at in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        if keep:
            gates, pulled = np.empty_like(gates), np.empty_like(pulled)
        np.take(embed, segments[at], axis=1, out=gates, mode="clip")
        np.matmul(recur, state, out=pulled)
        both, candidate, inner = gates[: 2 * hidden], gates[2 * hidden :], pulled[2 * hidden :]
        both += pulled[: 2 * hidden]
        _softsign(both, scratch[: 2 * hidden])
        both *= 0.5
        both += 0.5
        update, reset = both[:hidden], both[hidden:]
        inner += bias
        candidate += np.multiply(reset, inner, out=scratch[:hidden])
        _softsign(candidate, scratch[:hidden])
        if keep:
            kept[at] = (state, update, reset, inner, candidate)
        following = np.subtract(state, candidate, out=states[at])
        following *= update
        following += candidate
        state = following
    return states, kept


def _probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(T, L, N) label probabilities of every position."""
    hidden = forward.shape[1]
    z = np.matmul(net.out[:, :hidden], forward)
    z += np.matmul(net.out[:, hidden:], backward)
    z += net.out_bias
    np.minimum(z, np.float32(60), out=z)  # states stay below 1, so sums of weights bound z; no need to subtract the largest
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _slope(squashed: np.ndarray) -> np.ndarray:
    """The derivative of softsign, from its value."""
    return (1 - np.abs(squashed)) ** 2


def _backward(net: Network, segments: np.ndarray, direction: int, kept: dict, d_states: np.ndarray, grads: dict) -> None:
    """Add the gradients of one direction, walking the steps in reverse."""
    hidden = net.recur.shape[2]
    steps = segments.shape[0]
    carried = np.zeros_like(d_states[0])
    recur = net.recur[direction]
    for at in range(steps - 1, -1, -1) if direction == 0 else range(steps):
        state, update, reset, inner, candidate = kept[at]
        d = d_states[at] + carried
        d_candidate = d * (1 - update) * _slope(candidate)
        d_update = d * (state - candidate) * 0.5 * _slope(2 * update - 1)
        d_inner = d_candidate * reset
        d_reset = d_candidate * inner * 0.5 * _slope(2 * reset - 1)
        d_gates = np.concatenate([d_update, d_reset, d_candidate])
        d_pulled = np.concatenate([d_update, d_reset, d_inner])
        carried = d * update + recur.T @ d_pulled
        grads["recur"][direction] += d_pulled @ state.T
        grads["bias"][direction] += d_inner.sum(axis=1, keepdims=True)
        seen = np.zeros((257, segments.shape[1]), dtype=np.float32)
        seen[segments[at], np.arange(segments.shape[1])] = 1
        grads["embed"][direction] += d_gates @ seen.T


def gradients(net: Network, segments: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of the letter positions and its gradients; ``target`` holds one language index per segment."""
    runs = [_run(net, segments, d, keep=True) for d in (0, 1)]
    forward, backward = runs[0][0], runs[1][0]
    hidden = forward.shape[1]
    p = _probabilities(net, forward, backward)
    weight = LETTER[segments]
    total = max(float(weight.sum()), 1.0)
    picked = np.take_along_axis(p, target[None, None, :].repeat(len(p), axis=0), axis=1)[:, 0]
    loss = float(-(np.log(picked + 1e-12) * weight).sum() / total)
    dz = p
    dz -= np.arange(len(net.out))[:, None] == target
    dz *= (weight / total)[:, None, :]
    grads = {n: np.zeros_like(getattr(net, n)) for n in ("embed", "recur", "bias", "out", "out_bias")}
    turned = dz.transpose(0, 2, 1)
    grads["out"][:, :hidden] = np.matmul(forward, turned).sum(axis=0).T
    grads["out"][:, hidden:] = np.matmul(backward, turned).sum(axis=0).T
    grads["out_bias"][:] = dz.sum(axis=(0, 2))[:, None]
    for d in (0, 1):
        d_states = np.matmul(net.out[:, d * hidden : (d + 1) * hidden].T, dz)
        _backward(net, segments, d, runs[d][1], d_states, grads)
    grads["embed"][:, :, PAD] = 0
    return loss, grads


def fresh(languages: tuple[str, ...], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    embed = draw(2, 3 * hidden, 257, scale=0.3)
    embed[:, :, PAD] = 0
    embed[:, :hidden, PAD] = 1e7  # update gate of 1: the state passes through
    return Network(
        languages, embed, draw(2, 3 * hidden, hidden, scale=hidden**-0.5), np.zeros((2, hidden, 1), np.float32),
        draw(len(languages), 2 * hidden, scale=0.3), np.zeros((len(languages), 1), np.float32),
    )


def train(languages: tuple[str, ...], segments: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit a network to segments (N, T) by Adam."""
    net, rng = fresh(languages, seed=seed), np.random.default_rng(seed)
    names = ("embed", "recur", "bias", "out", "out_bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    steps, total = 0, max(1, epochs * -(-len(segments) // MINIBATCH))
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        for at in range(0, len(order), MINIBATCH):
            rows = order[at : at + MINIBATCH]
            _, grads = gradients(net, np.ascontiguousarray(segments[rows].T), target[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            shrink = min(1.0, 1.0 / (size + 1e-9))
            steps += 1
            rate = RATE * (1 - 0.9 * steps / total)
            for n in names:
                g = grads[n] * np.float32(shrink)
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                move = first[n] / (1 - 0.9**steps) / (np.sqrt(second[n] / (1 - 0.99**steps)) + 1e-6)
                getattr(net, n)[...] -= np.float32(rate) * move
    return net


def _segments(data: bytes) -> np.ndarray:
    """(n, STEPS) positions of a whole text, padded at its end."""
    out = np.full(-(-len(data) // STEPS) * STEPS, PAD, dtype=np.intp)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(-1, STEPS)


def learn(documents: DataFrame, held_out_fold: int | None = 0) -> Network:
    """Train on at most TEXTS_PER_LANGUAGE documents of each language, SEGMENTS_PER_TEXT segments of each."""
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if held_out_fold is not None:
        known = known.where(~is_fold(F.col("doc_id"), held_out_fold))
    languages = tuple(sorted(r["lang"] for r in known.select("lang").distinct().collect()))
    if not languages:
        return Network()
    ids = None
    for language in languages:
        part = smallest(known.where(F.col("lang") == language).select("doc_id", "lang"), "doc_id", TEXTS_PER_LANGUAGE)
        ids = part if ids is None else ids.union(part)
    picked = F.broadcast(ids.distinct())
    rows = known.where(F.col("text").isNotNull()).join(picked, ["doc_id", "lang"])
    rows = rows.mapInArrow(_sampled, "lang string, segment binary").toPandas().sort_values(["lang", "segment"])
    if len(languages) == 1 or not len(rows):
        return Network(languages[:1] if len(languages) == 1 else ())
    segments = np.stack([np.frombuffer(s, dtype=np.int16).astype(np.intp) for s in rows["segment"]])
    target = np.searchsorted(np.array(languages), rows["lang"].to_numpy(str))
    return train(languages, segments, target)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in byte_slices(batch, "text"):
            langs, segments = [], []
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                found = _segments(text.encode("utf-8", "surrogatepass"))
                if len(found) > SEGMENTS_PER_TEXT:
                    found = found[np.linspace(0, len(found) - 1, SEGMENTS_PER_TEXT).astype(int)]
                langs += [lang] * len(found)
                segments += [row.astype(np.int16).tobytes() for row in found]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(segments, pa.binary())], ["lang", "segment"])


def position_labels(net: Network, segments: np.ndarray) -> np.ndarray:
    """(T, L, N) probabilities for segments (N, T)."""
    turned = np.ascontiguousarray(segments.T)
    return _probabilities(net, _run(net, turned, 0)[0], _run(net, turned, 1)[0])


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not net.languages or not lettered:
        return found
    if len(net.languages) == 1:
        for i in lettered:
            found[i] = (net.languages[0], 1.0)
        return found
    parts = [_segments(texts[i].encode("utf-8", "surrogatepass")) for i in lettered]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    stacked = np.concatenate(parts)
    sums = np.zeros((len(parts), len(net.languages)))
    for at in range(0, len(stacked), SEGMENTS_AT_ONCE):
        here = stacked[at : at + SEGMENTS_AT_ONCE]
        p = position_labels(net, here)
        per_segment = np.einsum("tln,nt->nl", p, LETTER[here])
        np.add.at(sums, owner[at : at + SEGMENTS_AT_ONCE], per_segment)
    shares = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
    for row, i in enumerate(lettered):
        best = int(shares[row].argmax())
        found[i] = (net.languages[best], float(min(1.0, shares[row, best])))
    return found


def identify(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    content = documents.sparkSession.sparkContext.broadcast(net)  # a few ten thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                found = predict(content.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(documents: DataFrame, net: Network, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a language, all columns as they are."""
    content = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                found = predict(content.value, texts)
                yield part.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
