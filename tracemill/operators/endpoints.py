"""Naming endpoints from lookup tables, and telling what network element they are.

Lookups run on the distinct endpoints of the data, not on packets: an endpoint is
``(ip, hostname, service port class, point code)``.  Packets are joined back on one text key.
No side is broadcast by hint; Spark broadcasts a lookup when its measured size allows it and
splits hot keys of the packet side otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.addresses import address_bits, address_width, network_length, network_prefix
from tracemill.functions.convert import lookup
from tracemill.functions.tables import ELEMENT_TYPES, HOSTNAME_ELEMENTS, PORT_ELEMENTS, PORT_ROLES
from tracemill.functions.sqltext import sql_map
from tracemill.session import cut_lineage

ENTRY = "struct<hostname:string,alias:string,role:string,site:string,labels:map<string,string>,override:string>"
KNOWN_PORTS = sorted(set(PORT_ROLES) | set(PORT_ELEMENTS))
KEY_PARTS = ["ip", "hostname", "port", "has_port", "point_code"]


@dataclass
class Lookups:
    """Lookup tables as the readers give them; any may be missing."""

    hosts: DataFrame | None = None
    nodes: DataFrame | None = None
    subnets: DataFrame | None = None
    point_codes: DataFrame | None = None
    elements: DataFrame | None = None


# ------------------------------------------------------------------ endpoints
def known_port(port: Column) -> Column:
    """The port when a rule mentions it; others make no difference between endpoints."""
    return F.when(port.isin(KNOWN_PORTS), port)


def endpoint(ip: Column, port: Column | None = None, point_code: Column | None = None, hostname: Column | None = None) -> Column:
    """Struct of the parts that decide how an endpoint resolves."""
    none = F.lit(None).cast("string")
    port = F.lit(None).cast("int") if port is None else port.cast("int")
    code = none if point_code is None else F.nullif(F.upper(F.trim(point_code)), F.lit(""))
    return F.struct(
        ip.cast("string").alias("ip"),
        (none if hostname is None else hostname).alias("hostname"),
        known_port(port).alias("port"),
        port.isNotNull().alias("has_port"),
        code.alias("point_code"),
    )


def endpoint_key(e: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(e[p].cast("string"), F.lit("")) for p in KEY_PARTS])


def occurrences(df: DataFrame, src: Column, dst: Column, capture: str = "capture_id", order: str = "frame_no") -> DataFrame:
    """How often, and when last, each endpoint occurs per capture; source comes before destination."""
    both = df.select(
        capture,
        order,
        F.posexplode(F.array(src, dst)).alias("side", "endpoint"),
    )
    return both.groupBy(capture, "endpoint").agg(
        F.count(F.lit(1)).alias("packets"), F.max(F.col(order) * 2 + F.col("side")).alias("last_seen")
    )


# ------------------------------------------------------------------ lookups
def network_matches(ips: DataFrame, networks: DataFrame, payload: str) -> DataFrame:
    """First network in file order that contains each ``ip``: ``(ip, payload)``.

    A network is a prefix, so the range join is an equi-join on (address width, length, prefix).
    Every address is tried with the prefix lengths in use, of which there are at most 162; that
    list is the only broadcast.
    """
    nets = networks.selectExpr("*", f"{network_length('cidr')} as _len", f"{address_width('cidr')} as _width")
    nets = nets.selectExpr("*", f"{network_prefix('cidr', '_len')} as _prefix").where("_prefix is not null")
    nets = nets.groupBy("_width", "_len", "_prefix").agg(F.min("ord").alias("_ord"), F.min_by(payload, "ord").alias(payload))
    lengths = nets.select("_width", "_len").distinct()
    probe = ips.selectExpr("ip", f"{address_bits('ip')} as _bits").where("_bits is not null")
    probe = probe.withColumn("_width", F.length("_bits")).join(F.broadcast(lengths), "_width")
    probe = probe.selectExpr("ip", "_width", "_len", "left(_bits, _len) as _prefix")
    hits = probe.join(nets, ["_width", "_len", "_prefix"])
    return hits.groupBy("ip").agg(F.min_by(payload, "_ord").alias(payload))


def _entry(hostname=None, alias=None, role=None, site=None, labels=None, override=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (hostname if hostname is not None else none).alias("hostname"),
        (alias if alias is not None else none).alias("alias"),
        (role if role is not None else none).alias("role"),
        (site if site is not None else none).alias("site"),
        (labels if labels is not None else F.create_map().cast("map<string,string>")).alias("labels"),
        (override if override is not None else none).alias("override"),
    )


def _host_entry() -> Column:
    return _entry(hostname=F.col("hostname"), alias=F.col("hostname"))


def _node_entry() -> Column:
    labels = F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>"))
    return _entry(F.col("hostname"), F.col("alias"), F.col("role"), F.col("site"), labels, F.col("network_element_override"))


def _last_by(key: str, lookups: Lookups) -> DataFrame | None:
    """Last entry per address or lower-cased host name; the node map comes after the hosts."""
    value = F.col("ip") if key == "ip" else F.lower("hostname")
    parts = []
    if lookups.hosts is not None:
        parts.append(lookups.hosts.select(value.alias(key), F.lit(0).alias("_p"), "ord", _host_entry().alias("entry")))
    if lookups.nodes is not None:
        parts.append(lookups.nodes.select(value.alias(key), F.lit(1).alias("_p"), "ord", _node_entry().alias("entry")))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by("entry", F.struct("_p", "ord")).alias(f"{key}_entry"))
    )


def _networks(lookups: Lookups) -> DataFrame | None:
    """Networks of the node map, then those of the subnet file."""
    parts = []
    if lookups.nodes is not None:
        nodes = lookups.nodes.where(F.col("cidr").isNotNull())
        parts.append(nodes.select("cidr", F.struct(F.lit(0).alias("p"), F.col("ord").cast("bigint").alias("o")).alias("ord"), _node_entry().alias("net_entry")))
    if lookups.subnets is not None:
        parts.append(lookups.subnets.select("cidr", F.struct(F.lit(1).alias("p"), F.col("ord").cast("bigint").alias("o")).alias("ord"), _entry(alias=F.col("alias")).alias("net_entry")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def resolve(endpoints: DataFrame, lookups: Lookups, override: Column | None = None, observed_ports: Column | None = None) -> DataFrame:
    """Distinct endpoints (column ``endpoint``) with ``resolved``: ip, hostname, alias, role, site, labels and element columns.

    Order: exact address, host name, first network, point code; a role not given there comes
    from the service port.  ``observed_ports`` is an array of further ports of an endpoint; the element type then comes from the
    first of all its ports, the service port before the others, that a rule mentions.
    """
    none_entry = F.lit(None).cast(ENTRY)
    # few rows beside the packets, read once per lookup: written once
    rows = cut_lineage(endpoints.select("endpoint", "endpoint.*").distinct())
    addresses = rows.where("ip is not null").select("ip").distinct()

    by_ip, by_host, networks = _last_by("ip", lookups), _last_by("hostname", lookups), _networks(lookups)
    rows = rows.join(by_ip, "ip", "left") if by_ip is not None else rows.withColumn("ip_entry", none_entry)
    if by_host is not None:
        rows = rows.withColumn("_h", F.lower("hostname")).join(
            by_host.withColumnRenamed("hostname", "_h"), "_h", "left"
        ).drop("_h")
    else:
        rows = rows.withColumn("hostname_entry", none_entry)
    if networks is not None:
        rows = rows.join(network_matches(addresses, networks, "net_entry"), "ip", "left")
    else:
        rows = rows.withColumn("net_entry", none_entry)
    if lookups.point_codes is not None:
        codes = lookups.point_codes.groupBy("point_code").agg(F.max_by("alias", "ord").alias("code_alias"))
        rows = rows.join(codes, "point_code", "left")
    else:
        rows = rows.withColumn("code_alias", F.lit(None).cast("string"))

    code_entry = F.when(
        F.col("code_alias").isNotNull(),
        _entry(alias=F.col("code_alias"), role=F.lit("ss7"), labels=F.create_map(F.lit("ss7_point_code"), F.col("point_code"))),
    )
    rows = rows.withColumn("entry", F.coalesce("ip_entry", "hostname_entry", "net_entry", code_entry))
    rows = rows.withColumn("name_known", F.coalesce("hostname", "entry.hostname"))
    rows = rows.withColumn("role", F.coalesce("entry.role", lookup(PORT_ROLES, F.col("port"))))
    wanted = F.col("entry.override") if override is None else F.coalesce(override, F.col("entry.override"))
    rows = rows.withColumn("override", wanted)
    if observed_ports is not None:
        ports = F.concat(F.array("port"), F.coalesce(observed_ports, F.array().cast("array<int>")))
        rows = rows.withColumn("element_port", first_element_port(ports))
        rows = rows.withColumn("has_port", F.col("has_port") | (F.size(F.array_compact(ports)) > 0))
    else:
        rows = rows.withColumn("element_port", F.col("port"))
    rows = detect_elements(rows, lookups.elements, addresses)
    return rows.select("endpoint", endpoint_key(F.col("endpoint")).alias("endpoint_key"), _resolved().alias("resolved"))


def _resolved() -> Column:
    labels = {
        "ss7_point_code": "coalesce(entry.labels['ss7_point_code'], point_code)",
        "ss7_point_code_alias": "coalesce(entry.labels['ss7_point_code_alias'], code_alias)",
        "network_element_type": "element.type",
        "network_element_confidence": "cast(element.confidence as string)",
        "network_element_source": "element.source",
        "network_element_warning": "element.warning",
        "network_element_override": "if(element.source = 'manual_override', override, null)",
    }
    own = ", ".join(f"'{k}', {v}" for k, v in labels.items())
    keep = f"map_filter(entry.labels, (k, v) -> k not in ({', '.join(repr(k) for k in labels)}))"
    none = "cast(map() as map<string,string>)"
    merged = f"map_concat(coalesce({keep}, {none}), map_filter(map({own}), (k, v) -> v is not null))"
    return F.expr(
        f"struct(ip, name_known as hostname, entry.alias as alias, role, entry.site as site, {merged} as labels,"
        " element.type as element_type, element.confidence as element_confidence, element.source as element_source,"
        " element.warning as element_warning)"
    )


# ------------------------------------------------------------------ network elements
def hostname_element(name: str) -> str:
    """Element type of the first pattern that the host name contains."""
    cases = " ".join(f"when contains(lower({name}), '{part}') then '{kind}'" for part, kind in HOSTNAME_ELEMENTS)
    return f"case {cases} end"


def port_element(port: str) -> str:
    return f"{sql_map({p: kinds[0] for p, kinds in PORT_ELEMENTS.items()})}[{port}]"


def port_warning(port: str) -> str:
    texts = {p: f"Protocol-port heuristic is ambiguous ({'/'.join(k)})" for p, k in PORT_ELEMENTS.items() if len(k) > 1}
    return f"{sql_map(texts)}[{port}]"


def first_element_port(ports: Column) -> Column:
    """First of several observed ports that a rule mentions; repeated and missing ports are dropped."""
    seen = F.array_distinct(F.array_compact(ports))
    return F.get(F.filter(seen, lambda p: p.isin(list(PORT_ELEMENTS))), F.lit(0))


def detect_elements(rows: DataFrame, elements: DataFrame | None, addresses: DataFrame) -> DataFrame:
    """Add struct ``element``: type, confidence, source, warning.

    Priority: override, exact address, network, host-name pattern, port.  A lower signal that
    disagrees with the chosen one gives a warning.  Without any signal source it stays null.
    """
    missing = F.lit(None).cast("string")
    if elements is None:
        rows = rows.withColumn("by_ip", missing).withColumn("by_net", missing)
    else:
        exact = elements.where("kind = 'ip'").groupBy(F.expr(address_bits("value")).alias("_bits")).agg(
            F.max_by("element_type", "ord").alias("by_ip")
        )
        nets = elements.where("kind = 'subnet'").select(F.col("value").alias("cidr"), "ord", F.col("element_type").alias("by_net"))
        found = (
            addresses.selectExpr("ip", f"{address_bits('ip')} as _bits")
            .join(exact, "_bits", "left")
            .drop("_bits")
            .join(network_matches(addresses, nets, "by_net"), "ip", "left")
        )
        rows = rows.join(found, "ip", "left")
    sources = [
        ("by_ip", 100, "ip_mapping"),
        ("by_net", 90, "subnet_mapping"),
        (hostname_element("name_known"), 80, "hostname_pattern"),
        (port_element("element_port"), 50, "protocol"),
    ]
    signals = ", ".join(
        f"struct({kind} as type, {confidence} as confidence, '{source}' as source)" for kind, confidence, source in sources
    )
    rows = rows.selectExpr(
        "*",
        f"filter(array({signals}), s -> s.type is not null) as _signals",
        f"{sql_map({t.lower(): t for t in ELEMENT_TYPES})}[lower(override)] as _override",
    )
    detected = f"""case
        when _override is not null then
          struct(_override as type, 100 as confidence, 'manual_override' as source, cast(null as string) as warning)
        when size(_signals) = 0 then
          struct('unknown' as type, 0 as confidence, 'unknown' as source, cast(null as string) as warning)
        else struct(_signals[0].type as type, _signals[0].confidence as confidence, _signals[0].source as source,
          if(exists(_signals, s -> s.type <> _signals[0].type), 'Conflicting detection signals', {port_warning("element_port")}) as warning)
    end"""
    active = "true" if elements is not None else "override is not null or name_known is not null or has_port"
    return rows.selectExpr("*", f"if({active}, {detected}, null) as element").drop("_signals", "_override")


# ------------------------------------------------------------------ back to packets
def attach(df: DataFrame, lookups: Lookups, src: Column, dst: Column) -> DataFrame:
    """Add resolved ``src`` and ``dst`` structs to packets."""
    rows = df.withColumn("_src", src).withColumn("_dst", dst)
    distinct = rows.select(F.explode(F.array("_src", "_dst")).alias("endpoint")).distinct()
    resolved = cut_lineage(resolve(distinct, lookups))
    rows = rows.withColumn("_src_key", endpoint_key(F.col("_src"))).withColumn("_dst_key", endpoint_key(F.col("_dst")))
    for side in ("src", "dst"):
        named = resolved.select(F.col("endpoint_key").alias(f"_{side}_key"), F.col("resolved").alias(side))
        rows = rows.join(named, f"_{side}_key", "left")
    return rows.drop("_src", "_dst", "_src_key", "_dst_key")


def resolved_peers(seen: DataFrame, resolved: DataFrame, capture: str = "capture_id") -> DataFrame:
    """One row per capture and named address; the last named occurrence wins."""
    named = resolved.withColumn("name", F.coalesce("resolved.alias", "resolved.hostname")).where(
        F.col("name").isNotNull() & F.col("resolved.ip").isNotNull()
    )
    hits = seen.withColumn("endpoint_key", endpoint_key(F.col("endpoint"))).join(named.drop("endpoint"), "endpoint_key")
    last = hits.groupBy(capture, F.col("resolved.ip").alias("ip")).agg(
        F.max_by(F.struct("name", "resolved"), "last_seen").alias("_last")
    )
    name, found = F.col("_last.name"), F.col("_last.resolved")
    return last.select(
        capture,
        "ip",
        name.alias("name"),
        F.when(found["hostname"] != name, found["hostname"]).alias("hostname"),
        found["role"].alias("role"),
        found["element_type"].alias("network_element_type"),
        found["element_confidence"].alias("network_element_confidence"),
        found["element_source"].alias("network_element_source"),
        found["element_warning"].alias("network_element_warning"),
        found["labels"]["network_element_override"].alias("network_element_override"),
        found["labels"]["ss7_point_code"].alias("ss7_point_code"),
        found["labels"]["ss7_point_code_alias"].alias("ss7_point_code_alias"),
    )


def element_overview(seen: DataFrame, resolved: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Occurrences per element type and per source, and the distinct warnings: ``(capture, facet, name, packets)``."""
    hits = seen.withColumn("endpoint_key", endpoint_key(F.col("endpoint"))).join(resolved.drop("endpoint"), "endpoint_key")
    facets = F.expr(
        "stack(3, 'type', resolved.element_type, 'source', resolved.element_source, 'warning', resolved.element_warning)"
        " as (facet, name)"
    )
    return (
        hits.select(capture, "packets", facets)
        .where(F.col("name").isNotNull())
        .groupBy(capture, "facet", "name")
        .agg(F.sum("packets").alias("packets"))
    )
