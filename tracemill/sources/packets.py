"""Full packets: one JSON tree per packet, kept in its row as an array of leaves.

A leaf is one scalar with its place in the tree.  An Arrow function parses the text of a batch of packets
once, in one pass over each tree of any depth, so nothing is shuffled and no value is left unopened.  Repeated
keys stay separate leaves in their order, which is the list they stand for.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.arrays import array_items
from tracemill.sources.index import capture_key

LEAF = (
    "struct<pos:array<int>,top:string,second:string,path:string,key:string,depth:int,top_list:boolean,under_list:boolean,"
    "in_list:boolean,value:string,is_text:boolean>"
)
STEP_ROWS = 512
FRAME_NUMBER = "$['frame']['frame.number']"


class _Members(list):
    """The (key, value) pairs of an object, repeated keys included."""


class _Literal(str):
    """A number as it is written."""


_TREE = json.JSONDecoder(object_pairs_hook=_Members, parse_int=_Literal, parse_float=_Literal, parse_constant=_Literal, strict=False)


class _Place:
    """Where leaves may lie: what they share with all leaves of the same keys, and the places below, each made once a step."""

    __slots__ = ("columns", "number", "once", "again", "item")

    def __init__(self, columns: tuple, made: list[_Place]) -> None:
        # top, second, path, key, depth, top_list, under_list and in_list
        self.columns, self.number = columns, len(made)
        self.once, self.again, self.item = {}, {}, None
        made.append(self)

    def member(self, name: str, repeated: bool, made: list[_Place]) -> _Place:
        top, second, path, _, depth, top_list, under_list, in_list = self.columns
        if depth == 0:
            columns = (name, None, name, name, 1, False, False, repeated)
        else:
            layer_listed = in_list if depth == 1 else top_list
            columns = (top, name if second is None else second, f"{path}.{name}", name, depth + 1, layer_listed, under_list or in_list, repeated)
        place = (self.again if repeated else self.once)[name] = _Place(columns, made)
        return place

    def listed(self, made: list[_Place]) -> _Place:
        self.item = _Place((*self.columns[:7], True), made)
        return self.item


def _repeated(tree: _Members) -> set[str] | tuple:
    """Keys that an object has more than once."""
    if len(dict(tree)) == len(tree):
        return ()
    names = [name for name, _ in tree]
    return {n for n in names if names.count(n) > 1}


def _add_leaves(tree: _Members, root: _Place, made: list[_Place], flat: list[int], ends: list[int], places: list[int], values: list[str], texts: list[bool]) -> None:
    """Add the leaves of a packet, in document order: positions one after the other with their ends, numbers of places, values."""
    # the containers that are open: members still to come, repeated keys (None for a list), then pos and place
    stack: list[tuple] = [(enumerate(tree), _repeated(tree), (), root)]
    while stack:
        members, repeated, pos, place = stack[-1]
        once = place.once
        for n, value in members:
            if repeated is None:
                here = place.item or place.listed(made)
            else:
                name, value = value
                if name in repeated:
                    here = place.again.get(name) or place.member(name, True, made)
                else:
                    here = once.get(name) or place.member(name, False, made)
            if type(value) is str:
                texts.append(True)
            elif isinstance(value, _Members):
                stack.append((enumerate(value), _repeated(value), (*pos, n), here))
                break
            elif isinstance(value, list):
                stack.append((enumerate(value), None, (*pos, n), here))
                break
            elif value is None:
                continue
            else:
                value = str(value) if isinstance(value, _Literal) else "true" if value else "false"
                texts.append(False)
            flat += pos
            flat.append(n)
            ends.append(len(flat))
            places.append(here.number)
            values.append(value)
        else:
            stack.pop()


def _strings(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half of a surrogate pair in the export
        return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _leaf_array(texts: pa.Array) -> pa.Array:
    """The leaves of a batch, opened a few packets at a time: the Python objects of a step go before the next."""
    steps = [_leaf_step(texts.slice(start, STEP_ROWS).to_pylist()) for start in range(0, len(texts), STEP_ROWS)]
    return pa.concat_arrays(steps) if steps else _leaf_step([])


def _leaf_step(texts: list[str | None]) -> pa.Array:
    made: list[_Place] = []
    root = _Place(("", None, None, "", 0, False, False, False), made)
    offsets, absent, flat, ends, places, values, are_texts = [0], [], [], [0], [], [], []
    for text in texts:
        try:
            tree = _TREE.decode(text) if text is not None else None
        except (ValueError, RecursionError):
            tree = None
        absent.append(not isinstance(tree, _Members))
        if not absent[-1]:
            _add_leaves(tree, root, made, flat, ends, places, values, are_texts)
        offsets.append(len(values))
    columns = list(zip(*(place.columns for place in made), strict=True))
    shared = [_strings(list(c)) for c in columns[:4]] + [pa.array(columns[4], pa.int32()), *(pa.array(c, pa.bool_()) for c in columns[5:])]
    numbers = pa.array(places, pa.int32())
    fields = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
    fields += [c.take(numbers) for c in shared]
    fields += [_strings(values), pa.array(are_texts, pa.bool_())]
    names = [f.split(":")[0] for f in LEAF[len("struct<") : -1].replace("array<int>", "").split(",")]
    items = pa.StructArray.from_arrays(fields, names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=pa.array(absent, pa.bool_()))


def leaves_of(layers: Column) -> Column:
    """The leaves of a JSON object; null where the text is no complete object."""

    @F.arrow_udf(f"array<{LEAF}>")
    def opened(texts: pa.Array) -> pa.Array:
        return _leaf_array(texts)

    return opened(layers)


RECORD = "_source struct<layers: string>, _corrupt string"


def _sorted_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets and rejects of (capture_id, layers, record); ``record`` is set where the text is no JSON."""
    # layers that are an object are a text that starts with a brace
    sound = F.col("record").isNull() & F.coalesce(F.startswith("layers", F.lit("{")), F.lit(False))
    number = F.get_json_object("layers", FRAME_NUMBER).try_cast("bigint")
    packets = rows.where(sound).select("capture_id", number.alias("frame_no"), "layers")
    return packets, rows.where(~sound).select("capture_id", F.coalesce("record", "layers", F.lit("")).alias("record"))


def parse_packets(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Packets ``(capture_id, frame_no, layers)`` and rejects ``(capture_id, record)`` of ``(capture_id, value)`` lines."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.select("capture_id", F.from_json(line, RECORD, options).alias("r"))
    return _sorted_out(rows.select("capture_id", F.col("r._source.layers").alias("layers"), F.col("r._corrupt").alias("record")))


def read_packets(spark: SparkSession, path: str | Sequence[str], json_array: bool = False, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Packets ``(capture_id, frame_no, layers)`` and rejected records ``(capture_id, record)``.

    Files hold one packet object per line; a line that is no such object, or has no layers, is rejected, and ``reject_counts`` tells
    how many there are.  ``json_array`` reads files that are one JSON array each; large ones are cut and read by many tasks, and what is no
    such object is rejected by itself.  ``root`` is the folder that capture ids are relative to.
    """
    if json_array:
        return parse_packets(array_items(spark, path, root))
    capture = capture_key(F.col("_metadata.file_path"), path if root is None else root).alias("capture_id")
    lines = spark.read.text(path).select(capture, "value").where(F.trim("value") != "")
    return parse_packets(lines)


def reject_counts(packets: DataFrame, rejects: DataFrame) -> DataFrame:
    """Kept and rejected records per capture."""
    both = packets.select("capture_id", F.lit(0).alias("bad")).unionAll(rejects.select("capture_id", F.lit(1).alias("bad")))
    return both.groupBy("capture_id").agg(F.count_if(F.col("bad") == 0).alias("kept"), F.count_if(F.col("bad") == 1).alias("rejected"))


def with_leaves(packets: DataFrame, layers: str = "layers") -> DataFrame:
    """Add ``leaves`` and ``layer_names`` to packets.

    A leaf has ``pos`` (child numbers from the root), ``top`` and ``second`` (first two keys),
    ``path`` (all keys), ``key`` (the last one), ``depth`` (how many keys lead to it), ``top_list`` (its layer
    is a list), ``under_list`` (some key above is), ``in_list``, ``value`` and ``is_text``.  Nulls and empty objects have no leaf.  A text
    that cannot be parsed has null leaves, and its packet counts as malformed.
    """
    names = F.expr(f"coalesce(array_distinct(json_object_keys({layers})), array())")
    rows = packets.withColumn("layer_names", names)
    # behind a generator, so that later Arrow functions over the leaves are planned as a step of their own
    return rows.select("*", F.explode(F.array(leaves_of(F.col(layers)))).alias("leaves"))


def leaf_table(packets: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per leaf."""
    return packets.select(*keep, F.explode("leaves").alias("leaf")).select(*keep, "leaf.*")
