"""JSON arrays cut at any byte against the whole parse, and against line files."""

import json
import random

import pytest

from tracemill.sources.arrays import array_items
from tracemill.sources.packets import read_packets, reject_counts


@pytest.fixture
def cut_every(spark):
    """Let Spark cut files after so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield cut
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def packet(rng, n):
    odd = ['}', '{', '"', '\\', '}{"', '\\"}', '],[', 'é}', '\n', 'plain', '\\\\']
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(6)))
    extra = {text(): [text(), {"a": {}}, [[text()]], {"x}": text()}] for _ in range(rng.randrange(4))}
    return {"_index": text(), "_source": {"layers": {"frame": {"frame.number": str(n)}, "t": extra}}}


def items(spark, path):
    return sorted((r.capture_id, r.value) for r in array_items(spark, path).collect())


@pytest.mark.parametrize("size, indent", [(13, None), (61, 2), (300, None), (1 << 20, 2)])
def test_items_of_arrays(spark, tmp_path, cut_every, size, indent):
    rng = random.Random(size)
    want = []
    for name, count in (("one", 3 if size < 50 else 25), ("two", 1), ("none", 0)):
        held = [packet(rng, n) for n in range(count)]
        (tmp_path / f"{name}.json").write_text(json.dumps(held, indent=indent, ensure_ascii=name == "two") + rng.choice(["", "\n"]))
        want += [(name, p) for p in held]
    cut_every(size)
    got = [(name, json.loads(text)) for name, text in items(spark, str(tmp_path))]
    assert sorted(got, key=str) == sorted(want, key=str)
    if size == 61:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 30


@pytest.mark.parametrize("size", [11, 1 << 20])
def test_arrays_that_end_early_or_hold_other_things(spark, tmp_path, cut_every, size):
    cut_every(size)
    whole = json.dumps([{"a": {"b": "}"}}, {"c": [1, {"d": 2}]}])
    for n in range(0, len(whole), 1 if size > 100 else 5):
        (tmp_path / f"cut{n:03}.json").write_text(whole[:n])
    got = {}
    for name, value in items(spark, str(tmp_path)):
        got.setdefault(int(name[3:]), []).append(value)
    first, second = whole.index("}}") + 2, len(whole) - 1
    for n in range(0, len(whole), 1 if size > 100 else 5):
        sound = [v for v in got.get(n, []) if _parses(v)]
        assert sound == [whole[1:first]] * (n >= first) + [whole[first + 2 : second]] * (n >= second), n
        assert len(got.get(n, [])) - len(sound) == (1 < n < first or first + 2 < n < second), n


def _parses(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_packets_of_arrays_equal_those_of_lines(spark, tmp_path, cut_every):
    rng = random.Random(8)
    packets = [packet(rng, n) for n in range(20)] + [{"_source": {}}, {"other": 1}, {"_source": {"layers": "text"}}]
    for kind in ("array", "lines"):
        (tmp_path / kind).mkdir()
    (tmp_path / "array" / "cap.json").write_text(json.dumps(packets, indent=1))
    (tmp_path / "lines" / "cap.json").write_text("\n".join(map(json.dumps, packets)))
    cut_every(200)
    (a, bad_a), (b, bad_b) = (read_packets(spark, str(tmp_path / kind), json_array=kind == "array") for kind in ("array", "lines"))
    frames = lambda df: sorted((r.capture_id, r.frame_no, json.dumps(json.loads(r.layers))) for r in df.collect())
    assert frames(a) == frames(b) and a.count() == 20
    counts = lambda good, bad: sorted(tuple(r) for r in reject_counts(good, bad).collect())
    assert counts(a, bad_a) == counts(b, bad_b) == [("cap", 20, 3)]
