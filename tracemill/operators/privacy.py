"""Field-level privacy: classify a leaf by path and value, then protect it by the mode of its class.

A leaf is one scalar with its dotted path.  Everything runs row by row inside the scan: the rules
become one SQL ``CASE``, the modes another, and only pseudonyms pass through an Arrow function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from tracemill.functions import tables
from tracemill.functions.sqltext import bound
from tracemill.functions.pseudonym import DIGEST_BYTES, blake_hex, blake_hex_list

EXEMPT_PATHS = ("privacy.modes", "privacy_modes")
# (?U): word and digit classes cover all scripts
VALUE_PATTERNS = {
    "ip": "(?U)" + tables.IP_PATTERN,
    "email": tables.EMAIL_PATTERN,
    "uri": "(?iU)" + tables.URI_PATTERN,
    "token": "(?iU)" + tables.TOKEN_PATTERN,
    "imsi": "(?U)" + tables.IMSI_PATTERN,
    "msisdn": "(?U)" + tables.MSISDN_PATTERN,
}


@dataclass
class Numbering:
    """Hints for partial protection: network-code length per country code, destination codes."""

    imsi_mnc_lengths: dict[str, int] = field(default_factory=dict)
    msisdn_ndc_lengths: dict[str, int] = field(default_factory=dict)
    msisdn_ndc_prefixes: dict[str, list[str]] = field(default_factory=dict)

    def destination_codes(self) -> dict[str, list[str]]:
        codes = {**tables.DESTINATION_CODES, **self.msisdn_ndc_prefixes}
        codes.update({cc: ["?" * int(n)] for cc, n in self.msisdn_ndc_lengths.items()})
        return {cc: sorted(found, key=len, reverse=True) for cc, found in codes.items()}


def check_modes(modes: dict[str, str], key: str | bytes | None = None) -> None:
    """Fail before any data is read: unknown classes or modes, or encryption without a usable key."""
    wrong = {c: m for c, m in modes.items() if c not in tables.DATA_CLASSES or m not in tables.PROTECTION_MODES}
    if wrong:
        raise ValueError(f"unknown privacy classes or modes: {wrong}")
    if any("encrypt" in m for m in modes.values()):
        if key is None:
            raise ValueError("encryption needs a key")
        if len(key if isinstance(key, bytes) else key.encode()) not in (16, 24, 32):
            raise ValueError("the key must have 16, 24 or 32 bytes")


# ------------------------------------------------------------------ classification
# What a value must hold for a pattern to match, as a plain pattern that scans fast; other scripts have digits of their own.
IP_GATE = r"[0-9\P{ASCII}][.][0-9\P{ASCII}]{1,3}[.]|[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"
NUMBER_GATE = r"[0-9\P{ASCII}]{10}"
# Letters outside ASCII that equal an ASCII letter when case is ignored; lower-casing alone does not show them.
ODD_CASE = "\u0130\u0131\u017f\u212a"
LOWERED_WORDS = {"uri": "http:// https:// sip: tel: www.".split(), "token": "bearer authorization cookie token=".split()}


def matches(value: str, pattern: str, lowered: str = "lowered") -> str:
    """SQL test of a value pattern, behind a cheap test without which it cannot match; ``lowered`` is the value in lower case."""
    full = f"{value} rlike r'{VALUE_PATTERNS[pattern]}'"
    if pattern in LOWERED_WORDS:
        words = " or ".join(f"contains({lowered}, '{w}')" for w in LOWERED_WORDS[pattern])
        odd = " or ".join(f"contains({value}, '{c}')" for c in ODD_CASE)
        return f"(({words} or (octet_length({value}) > length({value}) and ({odd}))) and {full})"
    # before the gates stands what costs least: a mark or a length without which they cannot match
    gate = {
        "email": f"contains({value}, '@')",
        "ip": f"(contains({value}, '.') or contains({value}, ':')) and {value} rlike r'{IP_GATE}'",
    }.get(pattern, f"length({value}) >= 10 and {value} rlike r'{NUMBER_GATE}'")
    return f"({gate} and {full})"


def _any_part(parts: str) -> str:
    """SQL test of the lower-cased path ``q``."""
    return " or ".join(f"contains(q, '{p}')" for p in parts.split())


def data_class(path: str, value: str, protocol: str = "''", is_text: str = "true", fixed: bool = False) -> str:
    """SQL text for the data class of a leaf, null when none applies.

    Rules bound to a protocol come first, then the general ones (path part or value pattern),
    then the free-text rule, which looks at text only.  ``fixed`` says that ``path`` is a path itself and not SQL for one: its tests are made
    here, and only rules that can still apply are left in the expression.
    """
    known = lambda found: "true" if found else "false"
    part = (lambda parts: known(any(p in path.lower() for p in parts.split()))) if fixed else _any_part
    exempt = known(path.lower().startswith(EXEMPT_PATHS)) if fixed else " or ".join(f"startswith(q, '{p}')" for p in EXEMPT_PATHS)
    cases = [f"when {exempt} then null"]
    for kind, protocols, parts in tables.PROTOCOL_PRIVACY_RULES:
        listed = ", ".join(f"'{p}'" for p in protocols.split())
        if part(parts) != "false":
            cases.append(f"when lower({protocol}) in ({listed}) and ({part(parts)}) then '{kind}'")
    late: list[str] = []  # from the first rule on that looks at the lower-case value, which is made once
    for kind, parts, pattern in tables.GENERIC_PRIVACY_RULES:
        tests = [part(parts)] if part(parts) != "false" else []
        tests += [matches(value, pattern)] if pattern and "true" not in tests else []
        if tests:
            (late if late or pattern in LOWERED_WORDS else cases).append(f"when {' or '.join(tests)} then '{kind}'")
    markers = " or ".join(f"contains(lowered, '{m}')" for m in tables.FREE_TEXT_MARKERS)
    # e-mail, uri and token values were caught by their general rules already
    late.append(f"when {is_text} and ({markers} or {matches(value, 'imsi')} or {matches(value, 'msisdn')}) then 'payload_text'")
    rest = bound(f"lower({value})", "lowered", f"case {' '.join(late)} end")
    every = f"case {' '.join(cases)} else {rest} end"
    return every if fixed else bound(f"lower({path})", "q", every)


# ------------------------------------------------------------------ protection
def imsi_parts(value: str, numbering: Numbering) -> str:
    """SQL struct (prefix, suffix, country) of a subscriber number, null when it is not one."""
    cases = " ".join(f"when '{mcc}' then {int(n)}" for mcc, n in numbering.imsi_mnc_lengths.items())
    default = f"if(startswith({value}, '3'), 3, 2)"
    mnc = f"case left({value}, 3) {cases} else {default} end" if cases else default
    country = "case left({0}, 3) {1} end".format(
        value, " ".join(f"when '{mcc}' then '{name}'" for mcc, name in tables.COUNTRY_BY_MCC.items())
    )
    return _split_at(f"{value} rlike '^[0-9]{{7,15}}$'", value, f"3 + {mnc}", "''", country)


def _split_at(valid: str, digits: str, length: str, plus: str, country: str) -> str:
    return (
        f"if({valid} and length({digits}) > {length}, struct(concat({plus}, left({digits}, {length})) as prefix,"
        f" substr({digits}, {length} + 1) as suffix, {country} as country), null)"
    )


def country_code(digits: str) -> str:
    """SQL text for the calling code that starts ``digits``: longest first, else the first digit."""
    three = ", ".join(f"'{c}'" for c in tables.COUNTRY_CODES_3)
    two = ", ".join(f"'{c}'" for c in tables.COUNTRY_CODES_2)
    return f"case when left({digits}, 3) in ({three}) then left({digits}, 3) when left({digits}, 2) in ({two}) then left({digits}, 2) else left({digits}, 1) end"


def destination_code(cc: str, national: str, numbering: Numbering) -> str:
    """SQL text for the national destination code, '' when none is known."""
    cases = []
    for code, prefixes in numbering.destination_codes().items():
        tests = [
            f"when length({national}) > {len(p)} then left({national}, {len(p)})" if "?" in p
            else f"when startswith({national}, '{p}') then '{p}'"
            for p in prefixes
        ]
        cases.append(f"when {cc} = '{code}' then case {' '.join(tests)} else '' end")
    return f"case {' '.join(cases)} else '' end"


def msisdn_parts(value: str, numbering: Numbering) -> str:
    """SQL struct (prefix, suffix, country) of a telephone number, null when it is not one."""
    country = "case n.cc {0} end".format(" ".join(f"when '{cc}' then '{name}'" for cc, name in tables.COUNTRY_BY_CALLING_CODE.items()))
    valid = "n.ok and length(n.d) between 5 and 15"
    split = _split_at(valid, "n.d", "(length(n.cc) + length(n.ndc))", "n.plus", country)
    number = (
        f"named_struct('ok', trim({value}) rlike '^[+]?[0-9]+$', 'plus', if(startswith(trim({value}), '+'), '+', ''),"
        f" 'd', ltrim('+', trim({value})))"
    )
    with_cc = f"transform(array({number}), s -> named_struct('ok', s.ok, 'plus', s.plus, 'd', s.d, 'cc', {country_code('s.d')}))"
    ndc = destination_code("s.cc", "substr(s.d, length(s.cc) + 1)", numbering)
    with_ndc = f"transform({with_cc}, s -> named_struct('ok', s.ok, 'plus', s.plus, 'd', s.d, 'cc', s.cc, 'ndc', {ndc}))"
    return f"get(transform({with_ndc}, n -> {split}), 0)"


def split_parts(kind: str, value: str, modes: dict[str, str], numbering: Numbering) -> str:
    """SQL struct (prefix, suffix, country) where the mode of the class keeps a prefix, else null."""
    cases = []
    if modes.get("imsi", "").startswith("keep_mcc_mnc_"):
        cases.append(f"when {kind} = 'imsi' then {imsi_parts(value, numbering)}")
    if modes.get("msisdn", "").startswith("keep_cc_ndc_"):
        cases.append(f"when {kind} = 'msisdn' then {msisdn_parts(value, numbering)}")
    return f"case {' '.join(cases)} end" if cases else "cast(null as struct<prefix:string,suffix:string,country:string>)"


def digest_input(kind: str, value: str, parts: str, modes: dict[str, str]) -> str:
    """SQL text hashed for a pseudonym, null where the mode of the class needs none."""
    cases = []
    for cls, mode in modes.items():
        if mode == "pseudonymize":
            cases.append(f"when {kind} = '{cls}' then concat('{cls}:', {value})")
        elif "_pseudonymize_" in mode and _partial_fits(cls, mode):
            cases.append(f"when {kind} = '{cls}' then concat('{cls}_suffix:', {parts}.prefix, ':', {parts}.suffix)")
    return f"case {' '.join(cases)} end" if cases else "cast(null as string)"


def _partial_fits(cls: str, mode: str) -> bool:
    return (cls == "imsi" and mode.startswith("keep_mcc_mnc_")) or (cls == "msisdn" and mode.startswith("keep_cc_ndc_"))


def encrypted(value: str, key: str) -> str:
    return f"base64(aes_encrypt({value}, {key}, 'GCM'))"


def protected(kind: str, value: str, parts: str, digest: str, modes: dict[str, str], key: str | None = None) -> str:
    """SQL text for the protected value; null means the leaf is dropped."""
    red = f"'{tables.REDACTED}'"
    cases = []
    for cls, mode in modes.items():
        if mode == "keep":
            continue
        if mode == "remove":
            out = "null"
        elif mode == "pseudonymize":
            out = f"concat('{cls.upper()}_', {digest})"
        elif mode == "encrypt":
            out = encrypted(value, key)
        elif mode == "keep_tac_mask_serial" and cls == "imei":
            out = f"if(length({value}) <= 8, {red}, concat(left({value}, 8), repeat('X', length({value}) - 8)))"
        elif _partial_fits(cls, mode):
            if "_mask_" in mode:
                tail = f"repeat('X', length({parts}.suffix))"
            elif "_pseudonymize_" in mode:
                tail = f"concat('{cls.upper()}_SUFFIX_', {digest})"
            else:
                tail = encrypted(f"{parts}.suffix", key)
            country = f"if({parts}.country is null, '', concat(' (', {parts}.country, ')'))"
            out = f"if({parts} is null, {red}, concat({parts}.prefix, {tail}, {country}))"
        else:
            out = red
        cases.append(f"when {kind} = '{cls}' then {out}")
    return f"case {' '.join(cases)} else {value} end" if cases else value


def classify_leaves(leaves: DataFrame, path: str = "path", value: str = "value", protocol: str = "''", is_text: str = "true") -> DataFrame:
    """Add ``data_class``; ``path``, ``value``, ``protocol`` and ``is_text`` are SQL expressions."""
    return leaves.select("*", once(data_class(path, value, protocol, is_text)).alias("data_class"))


def once(sql: str) -> Column:
    """A costly expression as a generated column, so that later filters on it do not evaluate it again."""
    return F.explode(F.array(F.expr(sql)))


def protect_leaves(
    classified: DataFrame,
    modes: dict[str, str],
    value: str = "value",
    numbering: Numbering | None = None,
    key: Column | None = None,
    digest=blake_hex,
    digest_bytes: int = DIGEST_BYTES,
) -> DataFrame:
    """Add ``protected``; leaves whose protected value is null are dropped.

    ``key`` is a column, so that a secret comes from a table or a session variable and not from
    the text of the plan.
    """
    numbering = numbering or Numbering()
    rows = classified
    if key is not None:
        rows = rows.withColumn("_key", key)
    rows = rows.withColumn("_parts", F.expr(split_parts("data_class", value, modes, numbering)))
    if any("pseudonymize" in m for m in modes.values()):
        rows = rows.withColumn("_in", F.expr(digest_input("data_class", value, "_parts", modes)))
        rows = rows.withColumn("_digest", digest(F.col("_in"), digest_bytes))
    out = F.expr(protected("data_class", value, "_parts", "_digest", modes, "_key"))
    # an empty array gives no row, so dropped leaves need no filter over the whole expression
    rows = rows.select("*", F.explode(F.array_compact(F.array(out))).alias("protected"))
    return rows.drop("_parts", "_in", "_digest", "_key")


REPORT = "struct<data_class:string,issued_class:string,original:string,alias:string>"


def protect_leaf_lists(
    df: DataFrame,
    leaves: str,
    modes: dict[str, str],
    protocol: str = "''",
    path_prefix: str = "",
    numbering: Numbering | None = None,
    key: Column | None = None,
    digest_bytes: int = DIGEST_BYTES,
    report: str | None = None,
    keep_places: bool = False,
    digest_list=blake_hex_list,
) -> DataFrame:
    """Protect a column of leaf arrays in place, without taking packets apart.

    Items keep all their fields; only ``value`` changes, and items whose value becomes null go, unless ``keep_places`` is set.
    ``report`` names an array column to which the same pass adds one REPORT for every classified leaf: its class and, where a
    pseudonym was issued, the class, original and alias of that.  Items that have a ``kind`` are classified already.
    """
    numbering = numbering or Numbering()
    path = f"concat('{path_prefix}', l.path)"
    given = "kind" in df.schema[leaves].dataType.elementType.fieldNames()
    kind = "l.kind" if given else data_class(path, "l.value", protocol, "l.is_text")
    info = f"transform({leaves}, l -> named_struct('leaf', l, 'kind', {kind}))"
    rows = df.withColumn("_info", F.expr(info))
    if key is not None:
        rows = rows.withColumn("_key", key)
    rows = rows.withColumn(
        "_info",
        F.expr(
            "transform(_info, i -> named_struct('leaf', i.leaf, 'kind', i.kind, 'parts',"
            f" {split_parts('i.kind', 'i.leaf.value', modes, numbering)}))"
        ),
    )
    if any("pseudonymize" in m for m in modes.values()):
        inputs = f"transform(_info, i -> {digest_input('i.kind', 'i.leaf.value', 'i.parts', modes)})"
        rows = rows.withColumn("_digests", digest_list(F.expr(inputs), digest_bytes))
    else:
        rows = rows.withColumn("_digests", F.expr("array_repeat(cast(null as string), size(_info))"))
    if report is not None:
        before = f"coalesce({report}, array())" if report in df.columns else f"cast(array() as array<{REPORT}>)"
        rows = rows.withColumn(report, F.expr(f"concat({before}, {reported(modes)})"))
    value = protected("z._info.kind", "z._info.leaf.value", "z._info.parts", "z._digests", modes, "_key")
    fields = ", ".join(
        f"'{f}', {value if f == 'value' else f'z._info.leaf.{f}'}"
        for f in df.schema[leaves].dataType.elementType.fieldNames()
    )
    out = f"transform(arrays_zip(_info, _digests), z -> named_struct({fields}))"
    out = out if keep_places else f"filter({out}, l -> l.value is not null)"
    return rows.withColumn(leaves, F.expr(out)).drop("_info", "_digests", "_key")


def reported(modes: dict[str, str]) -> str:
    """SQL text: REPORT of every classified leaf of ``_info`` and ``_digests``."""
    whole = [c for c, m in modes.items() if m == "pseudonymize"]
    partial = [c for c, m in modes.items() if "_pseudonymize_" in m and _partial_fits(c, m)]
    cases = {"issued_class": [], "original": [], "alias": []}
    for cls in whole:
        when = f"when z._info.kind = '{cls}' and z._digests is not null then"
        cases["issued_class"].append(f"{when} '{cls}'")
        cases["original"].append(f"{when} z._info.leaf.value")
        cases["alias"].append(f"{when} concat('{cls.upper()}_', z._digests)")
    for cls in partial:
        when = f"when z._info.kind = '{cls}' and z._digests is not null then"
        cases["issued_class"].append(f"{when} '{cls}_suffix'")
        cases["original"].append(f"{when} concat(z._info.parts.prefix, ':', z._info.parts.suffix)")
        cases["alias"].append(f"{when} concat('{cls.upper()}_SUFFIX_', z._digests)")
    show = lambda name: f"case {' '.join(cases[name])} end" if cases[name] else "cast(null as string)"
    parts = ", ".join(f"'{name}', {show(name)}" for name in cases)
    known = "filter(arrays_zip(_info, _digests), z -> z._info.kind is not null and z._info.leaf.value is not null)"
    return f"transform({known}, z -> named_struct('data_class', z._info.kind, {parts}))"


def check_key(spark: SparkSession, modes: dict[str, str], key: Column | None) -> None:
    """Fail before any data is read: the key itself is evaluated once, and must have a usable length."""
    length = None
    if key is not None and any("encrypt" in m for m in modes.values()):
        length = spark.range(1).select(F.octet_length(key)).first()[0]
    check_modes(modes, None if length is None else "0" * length)


# ------------------------------------------------------------------ reports
def pseudonym_map(classified: DataFrame, modes: dict[str, str], value: str = "value", digest=blake_hex, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """Distinct ``(data_class, original, alias)`` of the fully pseudonymised classes."""
    wanted = [c for c, m in modes.items() if m == "pseudonymize"]
    distinct = (
        classified.where(F.col("data_class").isin(wanted) & F.expr(f"{value} is not null"))
        .select("data_class", F.expr(value).alias("original"))
        .distinct()
    )
    hashed = digest(F.concat_ws(":", "data_class", "original"), digest_bytes)
    return distinct.withColumn("alias", F.concat(F.upper("data_class"), F.lit("_"), hashed))


def issued_pseudonyms(reports: DataFrame, report: str = "report") -> DataFrame:
    """Distinct ``(data_class, original, alias)`` that the protecting pass issued; partial ones have the class ``<class>_suffix``."""
    # the outer form: for the other one Spark infers a filter on the size of the report, which makes the whole report twice
    rows = reports.select(F.explode_outer(report).alias("r")).where(F.col("r.alias").isNotNull())
    return rows.select(F.col("r.issued_class").alias("data_class"), "r.original", "r.alias").distinct()


def open_leaves(reports: DataFrame, modes: dict[str, str], report: str = "report", capture: str = "capture_id") -> DataFrame:
    """Leaves per capture and sensitive class that the protecting pass left in the clear."""
    return leak_audit(reports.select(capture, F.explode_outer(report).alias("r")).select(capture, "r.data_class"), modes, capture)


def pseudonym_audit(mapping: DataFrame) -> DataFrame:
    """Distinct originals per class."""
    return mapping.groupBy("data_class").agg(F.count(F.lit(1)).alias("originals"))


def pseudonym_collisions(mapping: DataFrame) -> DataFrame:
    """Aliases shared by several originals; raise the digest size when there are any."""
    return (
        mapping.groupBy("data_class", "alias")
        .agg(F.count(F.lit(1)).alias("originals"))
        .where(F.col("originals") > 1)
    )


def leak_audit(classified: DataFrame, modes: dict[str, str], capture: str = "capture_id") -> DataFrame:
    """Leaves per capture and sensitive class that the modes leave in the clear."""
    open_classes = [c for c in tables.SHARE_CHECK_CLASSES if modes.get(c, "keep") == "keep"]
    return (
        classified.where(F.col("data_class").isin(open_classes))
        .groupBy(capture, "data_class")
        .agg(F.count(F.lit(1)).alias("leaves"))
    )


def canonical_rollup(classified: DataFrame) -> DataFrame:
    """Leaves per canonical class; a data class can belong to two of them."""
    counted = classified.where("data_class is not null").groupBy("data_class").agg(F.count(F.lit(1)).alias("n"))
    owners: dict[str, list[str]] = {}
    for canonical, classes in tables.CANONICAL_CLASSES.items():
        for cls in classes:
            owners.setdefault(cls, []).append(canonical)
    listed = ", ".join(f"'{c}', array({', '.join(repr(o) for o in names)})" for c, names in owners.items())
    return (
        counted.selectExpr(f"explode(map({listed})[data_class]) as canonical_class", "n")
        .groupBy("canonical_class")
        .agg(F.sum("n").alias("leaves"))
    )


# ------------------------------------------------------------------ whole packets
PACKET_TEXTS = {
    "time_epoch": "time_epoch",
    "top_protocol": "top_protocol",
    **{f"{side}.{part}": f"{side}.{part}" for side in ("src", "dst") for part in ("ip", "hostname", "alias", "role", "site")},
    "transport.proto": "transport.proto",
    "transport.stream": "transport.stream",
    "transport.sctp_stream": "transport.sctp_stream",
}
PACKET_LISTS = {"frame_protocols": "frame_protocols", "transport.notes": "transport.notes", "anomalies": "anomalies"}


def protect_packets(
    packets: DataFrame, modes: dict[str, str], numbering: Numbering | None = None, key: Column | None = None,
    report: str | None = None, digest_list=blake_hex_list,
) -> DataFrame:
    """Protect every text of normalised packets: addresses, names, labels, times, notes and message fields.

    ``src`` and ``dst`` are resolved endpoints with ``labels``.  Message fields have the path
    ``message.fields.<path>``, as the rules expect.
    """
    # the paths of all texts but labels are known here, so most of their classes are too
    text = lambda path, value: (
        f"named_struct('path', '{path}', 'value', {value}, 'is_text', true, 'kind', {data_class(path, value, 'top_protocol', fixed=True)})"
    )
    transport = packets.schema["transport"].dataType.fieldNames()
    kept = lambda path: not path.startswith("transport.") or path.split(".")[1] in transport
    texts = ", ".join(text(path, col) for path, col in PACKET_TEXTS.items() if kept(path))
    lists = ", ".join(f"transform(coalesce({col}, array()), v -> {text(path, 'v')})" for path, col in PACKET_LISTS.items() if kept(path))
    labels = ", ".join(
        f"transform(map_entries(coalesce({side}.labels, cast(map() as map<string,string>))),"
        f" e -> named_struct('path', concat('{side}.labels.', e.key), 'value', e.value, 'is_text', true,"
        f" 'kind', {data_class(f"concat('{side}.labels.', e.key)", 'e.value', 'top_protocol')}))"
        for side in ("src", "dst")
    )
    rows = packets.withColumn("_texts", F.expr(f"filter(concat(array({texts}), {lists}, {labels}), l -> l.value is not null)"))
    rows = protect_leaf_lists(rows, "_texts", modes, "top_protocol", "", numbering, key, report=report, digest_list=digest_list)
    rows = protect_leaf_lists(rows, "fields", modes, "top_protocol", "message.fields.", numbering, key, report=report, digest_list=digest_list)
    one = lambda path: f"get(filter(_texts, l -> l.path = '{path}'), 0).value"
    many = lambda path: f"transform(filter(_texts, l -> l.path = '{path}'), l -> l.value)"

    def endpoint(side: str) -> str:
        parts = ", ".join(f"{one(f'{side}.{part}')} as {part}" for part in ("ip", "hostname", "alias", "role", "site"))
        start = f"{side}.labels."
        entries = f"transform(filter(_texts, l -> startswith(l.path, '{start}')), l -> struct(substr(l.path, {len(start) + 1}) as key, l.value as value))"
        return f"struct({parts}, map_from_entries({entries}) as labels)"

    carried = ", ".join(
        f"{one(f'transport.{f}')} as {f}" if f in ("proto", "stream", "sctp_stream") else f"{many('transport.notes')} as notes" if f == "notes" else f"transport.{f} as {f}"
        for f in transport
    )
    # the classes above read the original protocol, so it is replaced last
    out = {
        "src": endpoint("src"),
        "dst": endpoint("dst"),
        "transport": f"struct({carried})",
        "frame_protocols": many("frame_protocols"),
        "anomalies": many("anomalies"),
        "time_epoch": one("time_epoch"),
        "top_protocol": one("top_protocol"),
    }
    return rows.select(
        *[F.expr(out[c]).alias(c) if c in out else F.col(c) for c in packets.columns], *([report] if report else [])
    )


# ------------------------------------------------------------------ results of any shape
EXEMPT_COLUMNS = ("capture_id", "schema_version", "profile", "privacy_modes")


def _leaf(place: int, path: str, value: str) -> str:
    return f"named_struct('place', {place}, 'path', {path}, 'value', {value}, 'is_text', true)"


def _text_places(kind: DataType, sql: str, path: str, places: list[str]) -> str | None:
    """Add to ``places`` the SQL of the leaves of every text below ``sql``; return SQL that puts the protected texts back, null if there is none."""
    mine = f"filter(_leaves, l -> l.place = {len(places)})"
    if isinstance(kind, StringType):
        places.append(f"array({_leaf(len(places), repr(path), sql)})")
        return f"get({mine}, 0).value"
    if isinstance(kind, StructType):
        parts, found = [], False
        for f in kind.fields:
            back = _text_places(f.dataType, f"{sql}.`{f.name}`", f"{path}.{f.name}" if path else f.name, places)
            found = found or back is not None
            parts.append(f"'{f.name}', {back or f'{sql}.`{f.name}`'}")
        return f"if({sql} is null, null, named_struct({', '.join(parts)}))" if found else None
    if isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
        below = f"concat('{path}.', e.key)"
        places.append(f"transform(coalesce(map_entries({sql}), array()), e -> {_leaf(len(places), below, 'e.value')})")
        # a removed value takes its key with it
        kept = f"filter(transform(map_keys({sql}), (k, i) -> struct(k as key, {mine}[i].value as value)), x -> x.value is not null)"
        return f"if({sql} is null, null, map_from_entries({kept}))"
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        places.append(f"transform(coalesce({sql}, array()), v -> {_leaf(len(places), repr(path), 'v')})")
        return f"if({sql} is null, null, filter(transform({mine}, l -> l.value), v -> v is not null))"
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        parts, found = [], False
        for f in kind.elementType.fields:
            if isinstance(f.dataType, StringType):
                place, found = len(places), True
                below = f"{path}.{f.name}"
                places.append(f"transform(coalesce({sql}, array()), v -> {_leaf(place, repr(below), f'v.`{f.name}`')})")
                parts.append(f"'{f.name}', get(filter(_leaves, l -> l.place = {place}), i).value")
            elif isinstance(f.dataType, (StructType, ArrayType, MapType)):
                raise ValueError(f"{path}.{f.name}: texts in lists of lists are not protected; flatten them first")
            else:
                parts.append(f"'{f.name}', v.`{f.name}`")
        return f"transform({sql}, (v, i) -> named_struct({', '.join(parts)}))" if found else None
    return None


def protect_payload(
    df: DataFrame, modes: dict[str, str], numbering: Numbering | None = None, key: Column | None = None,
    report: str | None = None, exempt: Sequence[str] = EXEMPT_COLUMNS, digest_list=blake_hex_list,
) -> DataFrame:
    """Protect every text of a result table, whatever its columns: plain, in structs, lists, lists of structs and map values.

    Paths are those of the columns; the ``exempt`` columns stay as they are.  A removed text is null, and leaves its list or map.
    """
    places: list[str] = []
    back = {f.name: _text_places(f.dataType, f"`{f.name}`", f.name, places) for f in df.schema.fields if f.name not in exempt}
    if not places:
        return df if report is None else df.withColumn(report, F.expr(f"cast(array() as array<{REPORT}>)"))
    rows = df.withColumn("_leaves", F.expr(f"concat({', '.join(places)})"))
    rows = protect_leaf_lists(rows, "_leaves", modes, numbering=numbering, key=key, report=report, keep_places=True, digest_list=digest_list)
    return rows.select(*[F.expr(back[c]).alias(c) if back.get(c) else F.col(c) for c in df.columns], *([report] if report else []))
