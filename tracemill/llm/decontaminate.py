"""Benchmark items in documents by pigeonhole edit matching.

Texts and items are lower-cased and every run of other characters than letters and digits becomes one space.  An item of m
characters may differ by k = floor(ERROR_SHARE * m) edits.  Cut into k + 1 pieces, at least one piece of it stands unchanged in
every such occurrence: all pieces of all items are searched at once (Aho-Corasick), and where a piece is found, Myers'
bit-parallel distance decides over the stretch of text in which the item could lie.

Items are taken in blocks of at most BLOCK_CHARS characters; a block is what a task holds, and each block is one pass over the
documents, so a larger benchmark means more passes and never more memory.

Defined cases: null texts and texts or items without letters and digits never match.  An item whose budget is 0 must occur
unchanged between word ends.  Repeated documents and repeated items match each.  Within one text the best occurrence of an
item is reported: smallest distance, then first end, then longest stretch; ``hits`` counts occurrences that do not overlap.  Positions count
characters of the normalised text.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import byte_slices

ERROR_SHARE = 0.08
BLOCK_CHARS = 1 << 20
SCHEMA = "doc_id long, item_id long, distance int, start long, end long, hits int"
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


class Pattern:
    """One item, ready for Myers' algorithm in both directions."""

    def __init__(self, text: str, budget: int):
        self.text, self.budget = text, budget
        self.forward, self.backward = self._masks(text), self._masks(text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = defaultdict(int)
        for place, char in enumerate(text):
            masks[char] |= 1 << place
        return dict(masks)

    def _scan(self, masks: dict[str, int], text: str, anchored: bool) -> Iterator[int]:
        """Distance of the item to the best stretch that ends at each position; ``anchored`` stretches begin at 0."""
        length = len(self.text)
        full, top = (1 << length) - 1, 1 << (length - 1)
        plus, minus, score, carry = full, 0, length, int(anchored)
        for char in text:
            equal = masks.get(char, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1 | carry) & full
            down = (down << 1) & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
            yield score

    def best(self, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best stretch of ``text`` within the budget."""
        distance, end = self.budget + 1, -1
        for at, score in enumerate(self._scan(self.forward, text, False)):
            if score < distance:
                distance, end = score, at + 1
        if end < 0:
            return None
        start = end
        for at, score in enumerate(self._scan(self.backward, text[:end][::-1], True)):
            if score == distance:
                start = end - at - 1
        return distance, start, end


class Matcher:
    """All pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[tuple[int, Pattern]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            budget = int(ERROR_SHARE * len(text))
            number = len(self.items)
            self.items.append((item_id, Pattern(text, budget)))
            if budget == 0:
                pieces[f" {text} "].append((number, -1))
                continue
            cuts = [round(i * len(text) / (budget + 1)) for i in range(budget + 2)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                pieces[text[first:last]].append((number, first))
        self.machine = ahocorasick.Automaton() if pieces else None
        for piece, uses in pieces.items():
            self.machine.add_word(piece, (len(piece), uses))
        if pieces:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, start, end, hits) of every item found in a text."""
        if self.machine is None or not text:
            return []
        body = f" {normal(text)} "
        places: dict[int, list[int]] = defaultdict(list)
        for last, (size, uses) in self.machine.iter(body):
            for number, offset in uses:
                places[number].append(last + 1 - size - offset)
        found = []
        for number in sorted(places):
            item_id, pattern = self.items[number]
            got = self._verify(body, pattern, places[number])
            if got:
                distance, start, end = min(got, key=lambda g: (g[0], g[2], g[1]))
                found.append((item_id, distance, start - 1, end - 1, len(got)))
        return found

    @staticmethod
    def _verify(body: str, pattern: Pattern, begins: list[int]) -> list[tuple[int, int, int]]:
        """Occurrences that do not overlap, near the places where the item would begin."""
        length, budget = len(pattern.text), pattern.budget
        if budget == 0:
            return [(0, b, b + length) for b in begins]
        stretches: list[list[int]] = []
        for begin in sorted(begins):
            first, last = max(0, begin - budget), min(len(body), begin + length + budget)
            if stretches and first <= stretches[-1][0] + 2 * budget:
                stretches[-1][1] = max(stretches[-1][1], last)
            else:
                stretches.append([first, last])
        found: list[tuple[int, int, int]] = []
        for first, last in stretches:
            best = pattern.best(body[first:last])
            if best and not (found and best[1] + first < found[-1][2]):
                found.append((best[0], best[1] + first, best[2] + first))
            elif best and best[0] < found[-1][0]:
                found[-1] = (best[0], best[1] + first, best[2] + first)
        return found


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (item_id, normalised text), streamed through the driver one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    block: list[tuple[int, str]] = []
    size = 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start, end and hits of every item found in every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, found = documents.sparkSession, None
    for block in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(_finding(items), SCHEMA)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def _finding(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value)
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                rows = [(doc_id, *hit) for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True) for hit in matcher.find(text)]
                names = ("doc_id", "item_id", "distance", "start", "end", "hits")
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no item is found, all columns as they are."""
    kept = documents
    for block in item_blocks(benchmark):
        items = documents.sparkSession.sparkContext.broadcast(block)
        kept = kept.mapInArrow(_keeping(items), documents.schema)
    return kept


def _keeping(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value)
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                yield part.filter(pa.array([not matcher.find(t) for t in texts], pa.bool_()))

    return run
