"""From leaves to normalised packets: field lookup, transport, addresses, retained message fields."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.sqltext import bound, select_once
from tracemill.operators.classify import top_protocol
from tracemill.sources.packets import STEP_ROWS
from tracemill.sources.profiles import Profile

FRAME_FIELDS = ["frame.number", "frame.time_epoch", "frame.time_relative", "frame.protocols"]
NETWORK_FIELDS = ["ip.src", "ip.dst", "ipv6.src", "ipv6.dst"]
TRANSPORT_FIELDS = """
sctp.srcport sctp.dstport sctp.assoc_index sctp.stream_identifier sctp.chunk_type
tcp.srcport tcp.dstport tcp.stream tcp.analysis.retransmission tcp.analysis.out_of_order
udp.srcport udp.dstport udp.stream
""".split()
POINT_CODE_FIELDS = ["mtp3.opc", "mtp3mg.opc", "mtp3.dpc", "mtp3mg.dpc"]
NORMAL_FIELDS = FRAME_FIELDS + NETWORK_FIELDS + TRANSPORT_FIELDS + POINT_CODE_FIELDS


def quoted(names: Iterable[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def named_leaves(names: Sequence[str], leaves: str = "leaves") -> str:
    """SQL text: leaves of fields that are flat, or nested below their protocol."""
    return (
        f"filter({leaves}, l -> l.depth <= 2 and l.key in ({quoted(names)}) and not l.under_list"
        " and (l.depth = 1 or l.top = split_part(l.key, '.', 1)))"
    )


def field_entries(few: str) -> str:
    """SQL text: one (key, value) per field: one value as it is, several as JSON text; a flat field wins."""
    chosen = bound(f"filter({few}, l -> l.key = k)", "h", "if(exists(h, l -> l.depth = 1), filter(h, l -> l.depth = 1), h)")
    values = f"transform({chosen}, l -> l.value)"
    entry = bound(values, "v", "struct(k as key, if(size(v) = 1, v[0], to_json(v)) as value)")
    several = f"transform(array_distinct(transform({few}, l -> l.key)), k -> {entry})"
    # most packets have each field once, and need no search per field
    once = bound(f"transform({few}, l -> l.key)", "keys", "size(array_distinct(keys)) = size(keys)")
    return f"if({once}, transform({few}, l -> struct(l.key as key, l.value as value)), {several})"


def with_fields(df: DataFrame, names: Sequence[str], out: str = "f", leaves: str = "leaves") -> DataFrame:
    """Add a map of the named fields; the leaf array is searched once for all of them."""
    few = df.withColumn("_few", F.expr(named_leaves(names, leaves)))
    return few.withColumn(out, F.expr(f"map_from_entries({field_entries('_few')})")).drop("_few")


def field(name: str, leaves: str = "leaves") -> str:
    """SQL text of a single field lookup."""
    return f"get({bound(named_leaves([name], leaves), 'few', field_entries('few'))}, 0).value"


def deep_field(names: Sequence[str], leaves: str = "leaves", max_depth: int = 12) -> str:
    """SQL text: first scalar under any of the names, outer containers first, then document order."""
    rank = "case l.key " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(names)) + " end"
    hits = (
        f"transform(filter({leaves}, l -> l.key in ({quoted(names)}) and not l.in_list and size(l.pos) <= {max_depth}),"
        f" l -> struct(slice(l.pos, 1, size(l.pos) - 1) as place, {rank} as rank, l.value as value))"
    )
    return f"array_min({hits}).value"


def integer(text: str) -> str:
    return f"if(trim({text}) rlike '^[+-]?[0-9]+$', try_cast(trim({text}) as bigint), null)"


def transport(f: str = "f") -> str:
    """SQL struct of the transport: sctp before tcp before udp before plain ip."""
    has = lambda name: f"array_contains(layer_names, '{name}')"
    of = lambda name: f"{f}['{name}']"

    def context(proto: str, stream: str, sctp_stream: str, anomaly: str, notes: str) -> str:
        port = lambda side: integer(of(f"{proto}.{side}port")) if proto != "ip" else "cast(null as bigint)"
        return (
            f"struct('{proto}' as proto, try_cast({port('src')} as int) as src_port, try_cast({port('dst')} as int) as dst_port,"
            f" {stream} as stream, {sctp_stream} as sctp_stream, {anomaly} as anomaly, {notes} as notes)"
        )

    none, no_notes = "cast(null as string)", "cast(array() as array<string>)"
    chunk = of("sctp.chunk_type")
    # several chunk types read as a bracketed list
    chunks = f"if(startswith({chunk}, '['), replace(replace({chunk}, '\"', \"'\"), ',', ', '), {chunk})"
    sctp_notes = f"if({chunk} is null, {no_notes}, array(concat('chunks=', {chunks})))"
    set_flag = lambda name: f"coalesce({f}['tcp.analysis.{name}'], '') <> ''"
    tcp_notes = f"array_compact(array(if({set_flag('retransmission')}, 'retransmission', null), if({set_flag('out_of_order')}, 'out_of_order', null)))"
    tcp_anomaly = f"{set_flag('retransmission')} or {set_flag('out_of_order')}"
    analysed = f"{has('tcp.analysis')} or {has('sctp.analysis')}"
    return (
        f"case when {has('sctp')} then {context('sctp', of('sctp.assoc_index'), of('sctp.stream_identifier'), analysed, sctp_notes)}"
        f" when {has('tcp')} then {context('tcp', of('tcp.stream'), none, tcp_anomaly, tcp_notes)}"
        f" when {has('udp')} then {context('udp', of('udp.stream'), none, 'false', no_notes)}"
        f" else {context('ip', none, none, 'false', no_notes)} end"
    )


# ------------------------------------------------------------------ retained fields
def retained(profile: Profile, protocol: str = "top_protocol", leaves: str = "leaves") -> str:
    """SQL text: the leaves of a packet that its message keeps, with paths relative to the layer."""
    below = "substr(l.path, length(l.top) + 2)"
    cases = []
    for name in dict.fromkeys(profile.priority):
        layer = quoted(profile.layer_names(name))
        in_layer = f"l.depth >= 2 and l.top in ({layer}) and not startswith(l.second, '_ws.')"
        # a layer that is a list has no fields of its own
        in_layer = f"({in_layer} and not l.top_list)"
        if name in profile.verbatim:
            cases.append(f"when {protocol} = '{name}' then {_verbatim(profile, name, in_layer, below, leaves)}")
            continue
        path = f"if(l.depth = 1, l.path, {below})"
        chosen = f"filter({leaves}, l -> {in_layer})"
        if profile.fields.get(name):
            allowed = profile.fields[name]
            nested = f"l.depth >= 2 and {_listed('l.second', allowed)} and l.top = split_part(l.second, '.', 1) and not l.top_list"
            # a field that lies flat hides the one of the same name in a layer
            chosen = bound(
                f"transform(filter({leaves}, l -> l.depth = 1 and {_listed('l.key', allowed)}), l -> l.key)",
                "flat",
                f"filter({leaves}, l -> if(l.depth = 1, array_contains(flat, l.key), ({in_layer} or ({nested})) and not array_contains(flat, l.second)))",
            )
        cases.append(f"when {protocol} = '{name}' then transform({chosen}, l -> {_kept(path)})")
    return f"case {' '.join(cases)} else filter(transform({leaves}, l -> {_kept('l.path')}), l -> false) end"


def _listed(name: str, allowed: Sequence[str]) -> str:
    """SQL test whether a field is on a whitelist; ``x.*`` there stands for all names that start with ``x.``."""
    whole = [a for a in allowed if not a.endswith(".*")]
    tests = [f"startswith({name}, {quoted([a[:-1]])})" for a in allowed if a.endswith(".*")]
    if whole:
        tests.append(f"{name} in ({quoted(whole)})")
    return f"({' or '.join(tests)})"


def _kept(path: str) -> str:
    return f"struct({path} as path, l.key as key, l.pos as pos, l.in_list as in_list, l.value as value, l.is_text as is_text)"


def _verbatim(profile: Profile, name: str, in_layer: str, below: str, leaves: str) -> str:
    """All fields of the layer, and nested protocol fields lifted to the top, repeated values once."""
    parts = []
    for layer in profile.layer_names(name):
        flat = f"l.depth = 1 and startswith(l.key, '{layer}.') and not startswith(l.key, '_ws.')"
        parts.append(f"transform(filter({leaves}, l -> {flat}), l -> {_kept('l.path')})")
        parts.append(f"transform(filter({leaves}, l -> {in_layer} and l.top = '{layer}'), l -> {_kept(below)})")
        lifted = f"l.depth >= 3 and l.top = '{layer}' and not l.top_list and startswith(l.key, '{layer}.')"
        parts.append(f"transform(filter({leaves}, l -> {lifted}), l -> {_kept('l.key')})")
    merged = f"concat({', '.join(parts)})"
    # the first of equal (path, value) pairs stays: equal pairs are neighbours after a sort, which also knows the old order
    ranked = f"array_sort(transform({merged}, (l, n) -> struct(l.path as path, l.value as value, n as n, l as leaf)))"
    first = bound(ranked, "r", "filter(r, (x, n) -> n = 0 or not (r[n - 1].path = x.path and r[n - 1].value = x.value))")
    unique = f"transform(array_sort(transform({first}, x -> struct(x.n as n, x.leaf as leaf))), x -> x.leaf)"
    if name == "diameter" and not profile.keep_raw_avps:
        unique = f"filter({unique}, l -> not ({raw_avp('l.path')}))"
    return unique


def raw_avp(path: str) -> str:
    """SQL test for raw attribute dumps: ``diameter.avp*`` and ``diameter.*_tree``, whatever lies below."""
    return f"startswith({path}, 'diameter.avp') or {path} rlike '^diameter[.].*_tree([.]|$)'"


def normalise(packets: DataFrame, profile: Profile, time_scale: float = 1.0, keep: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Normalised packets, with ``is_valid`` false where a single-valued part has several values.

    ``time_rel_ms`` is the relative time of the export times ``time_scale``; exports that give
    seconds need 1000 for real milliseconds.
    """
    rows = with_fields(packets, NORMAL_FIELDS)
    rows = rows.withColumn(
        "frame_protocols", F.expr("coalesce(filter(split(f['frame.protocols'], ':'), p -> p <> ''), array())")
    )
    rows = rows.withColumn("_stack", F.expr("array_distinct(concat(frame_protocols, layer_names))"))
    rows = rows.withColumn("top_protocol", F.expr(top_protocol("_stack", profile)))
    rows = rows.withColumn("transport", F.expr(transport()))
    address = lambda side: (
        f"case when array_contains(layer_names, 'ip') then f['ip.{side}'] when array_contains(layer_names, 'ipv6') then f['ipv6.{side}'] end"
    )
    code = lambda side: f"nullif(coalesce(nullif(f['mtp3.{side}'], ''), f['mtp3mg.{side}']), '')"
    single = lambda col: f"not startswith(coalesce({col}, ''), '[')"
    # under an ``as`` the costly columns stay behind the generator, so that a filter on them does not evaluate the field map again
    rows = select_once(
        rows,
        *keep,
        f"coalesce({integer("f['frame.number']")}, 0) as packet_no",
        f"try_cast(f['frame.time_relative'] as double) * {time_scale} as time_rel_ms",
        "coalesce(f['frame.time_epoch'], '') as time_epoch",
        "top_protocol as top_protocol",
        "frame_protocols as frame_protocols",
        f"{address('src')} as src_ip",
        f"{address('dst')} as dst_ip",
        f"{code('opc')} as src_point_code",
        f"{code('dpc')} as dst_point_code",
        "transport as transport",
        "transport.notes as anomalies",
        f"{retained(profile)} as fields",
        "leaves is not null as parsed",
    )
    valid = " and ".join(single(c) for c in ("src_ip", "dst_ip", "transport.stream", "transport.sctp_stream"))
    return rows.withColumn("is_valid", F.expr(f"parsed and {valid}")).drop("parsed")


def dropped_packets(normalised: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Packets per capture that could not be normalised."""
    return normalised.groupBy(capture).agg(F.count_if(~F.col("is_valid")).alias("dropped_packets"))


def reduce_transport(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only the listed transport fields; an empty list of notes becomes null."""
    known = [f for f in df.schema["transport"].dataType.fieldNames() if f in set(keep)]
    show = lambda f: f"if(size(transport.{f}) = 0, null, transport.{f})" if f == "notes" else f"transport.{f}"
    return df.withColumn("transport", F.expr("struct(" + ", ".join(f"{show(f)} as {f}" for f in known) + ")"))


def _maps(rows: pa.Array) -> pa.Array:
    """Maps of a batch of leaf lists, made a few packets at a time: the Python objects of a step go before the next."""
    steps = [_map_step(rows.slice(start, STEP_ROWS)) for start in range(0, len(rows), STEP_ROWS)]
    return pa.concat_arrays(steps) if steps else _map_step(rows)


def _map_step(rows: pa.Array) -> pa.Array:
    sizes, leaves = rows.value_lengths().to_pylist(), rows.flatten()
    paths, texts = leaves.field("path").to_pylist(), leaves.field("value").to_pylist()
    offsets, keys, values, start = [0], [], [], 0
    for size in sizes:
        end = start + (size or 0)
        found: dict[str, list[str]] = {}
        for path, text in zip(paths[start:end], texts[start:end]):
            found.setdefault(path, []).append(text)
        keys += found
        values += [v[0] if len(v) == 1 else json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in found.values()]
        offsets.append(len(keys))
        start = end
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def field_map(fields: str = "fields") -> Column:
    """Map path -> text; several values of one path become a JSON array, in their order.  One pass over the leaves."""

    @F.arrow_udf("map<string,string>")
    def mapped(rows: pa.Array) -> pa.Array:
        return _maps(rows)

    return mapped(F.transform(fields, lambda l: F.struct(l["path"].alias("path"), l["value"].alias("value"))))
