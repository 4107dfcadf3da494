"""Lookup files, resolution order, network elements."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from tracemill.functions import addresses
from tracemill.operators import endpoints as ep
from tracemill.sources import lookups as lk


def test_address_bits(spark):
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "::", "::1", "2001:DB8::A", "1:2:3:4:5:6:7:8", "1::2::3", "::ffff:1.2.3.4",
             "1:2:3", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::1.2.3", "x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr(addresses.address_bits("t")).alias("b"))
    for row in df.collect():
        try:
            address = ipaddress.ip_address(row.t)
            want = format(int(address), "032b" if address.version == 4 else "0128b")
        except ValueError:
            want = None
        assert row.b == want, row.t


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_lookup_files(spark, tmp_path):
    hosts = lk.read_hosts(spark, write(tmp_path, "hosts", "# c\n10.0.0.1 mme-1 more\n\nalone\n10.0.0.1\tmme-2\n"))
    assert [(r.ip, r.hostname) for r in hosts.orderBy("ord").collect()] == [("10.0.0.1", "mme-1"), ("10.0.0.1", "mme-2")]
    nets = lk.read_subnets(spark, write(tmp_path, "nets", "10.0.0.0/8 core  net\nbad/99 x\n10.1.0.0/16\n2001:db8::/32 v6\n"))
    assert [(r.cidr, r.alias) for r in nets.orderBy("ord").collect()] == [("10.0.0.0/8", "core  net"), ("2001:db8::/32", "v6")]
    codes = lk.read_point_codes(spark, write(tmp_path, "codes", "0-2a1 STP West\nlonely\n"))
    assert [(r.point_code, r.alias) for r in codes.collect()] == [("0-2A1", "STP West")]
    nodes = lk.read_nodes(spark, write(tmp_path, "n.yaml", "nodes:\n- {ip: 1.1.1.1, alias: A, vendor: X, level: 3}\n- nonsense\n"))
    (node,) = nodes.collect()
    assert node.labels == {"vendor": "X", "level": "3"} and node.hostname is None


def test_element_file_is_strict(spark, tmp_path):
    good = write(tmp_path, "e.csv", "type,value,network_element_type\nIP,10.0.0.1,hss\nsubnet,10.0.0.0/24,eNodeB\n")
    assert [(r.kind, r.element_type) for r in lk.read_element_types(spark, good).orderBy("ord").collect()] == [("ip", "HSS"), ("subnet", "eNodeB")]
    for text in ("type,value\nip,1.1.1.1\n", "type,value,network_element_type\nip,1.1.1.1,Toaster\n", "type,value,network_element_type\nip,nope,HSS\n"):
        with pytest.raises(ValueError):
            lk.read_element_types(spark, write(tmp_path, "bad.csv", text))
        with pytest.warns(UserWarning, match="left out"):
            assert lk.read_element_types(spark, write(tmp_path, "bad.csv", text), strict=False).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    hosts = spark.createDataFrame([(0, "10.0.0.1", "mme-a"), (1, "10.0.0.1", "mme-b"), (2, "10.9.0.1", "hss9")], "ord bigint, ip string, hostname string")
    nodes = spark.createDataFrame(
        lk.node_rows([
            {"ip": "10.0.0.2", "alias": "AMF", "role": "amf", "site": "west", "rack": "7"},
            {"hostname": "Gate.Example", "alias": "gate"},
            {"cidr": "10.1.0.0/16", "alias": "node-net"},
            {"ip": "10.0.0.9", "alias": "forced", "network_element_override": "Upf"},
        ]),
        lk.NODE_SCHEMA,
    )
    subnets = spark.createDataFrame([(0, "10.0.0.0/8", "wide"), (1, "10.1.2.0/24", "narrow"), (2, "2001:db8::/32", "six")], "ord bigint, cidr string, alias string")
    codes = spark.createDataFrame([(0, "0-2A1", "STP")], "ord bigint, point_code string, alias string")
    elements = spark.createDataFrame(
        [(0, "ip", "10.0.0.1", "HSS"), (1, "subnet", "10.1.0.0/16", "SGW"), (2, "ip", "2001:db8:0::5", "MME")],
        "ord bigint, kind string, value string, element_type string",
    )
    return ep.Lookups(hosts, nodes, subnets, codes, elements)


def resolved(spark, lookups, *rows):
    data = [(i, *r, *[None] * (4 - len(r))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "n int, ip string, port int, code string, host string")
    df = df.withColumn("endpoint", ep.endpoint(F.col("ip"), F.col("port"), F.col("code"), F.col("host")))
    out = ep.resolve(df.select("endpoint"), lookups)
    return {r.n: r.resolved for r in df.withColumn("endpoint_key", ep.endpoint_key(F.col("endpoint"))).join(out.drop("endpoint"), "endpoint_key").collect()}


def test_resolution_order(spark, tables):
    got = resolved(
        spark, tables,
        ("10.0.0.1", 3868), ("10.0.0.2", 53), ("10.1.2.3",), ("10.7.7.7", 2123), ("2001:DB8::5",), (None, None, " 0-2a1 "),
        ("192.0.2.1", None, "0-2a1"), ("192.0.2.1", 38412), ("192.0.2.2", None, None, "gate.example"), ("10.0.0.9", None, "0-2a1"), ("bad", 9),
    )
    assert (got[0].hostname, got[0].alias, got[0].role) == ("mme-b", "mme-b", "diameter")
    assert (got[1].alias, got[1].role, got[1].site, got[1].labels["rack"]) == ("AMF", "amf", "west", "7")
    assert got[2].alias == "node-net" and got[3].alias == "wide" and got[3].role == "gtpc" and got[4].alias == "six"
    assert (got[5].alias, got[5].role, got[5].labels["ss7_point_code"], got[5].labels["ss7_point_code_alias"]) == ("STP", "ss7", "0-2A1", "STP")
    assert got[6].alias == "STP" and got[7].alias is None and got[7].role == "ngap"
    assert (got[8].alias, got[8].hostname) == ("gate", "gate.example")
    assert got[9].alias == "forced" and got[9].labels["ss7_point_code_alias"] == "STP"
    assert got[10].alias is None and got[10].element_type == "unknown"


def test_element_detection(spark, tables):
    got = resolved(spark, tables, ("10.0.0.1", 3868), ("10.1.5.5", 2123), ("10.9.0.1",), ("192.0.2.1", 2123), ("192.0.2.1", 2152), ("2001:db8::5",), ("10.0.0.9",))
    view = lambda r: (r.element_type, r.element_confidence, r.element_source, r.element_warning)
    assert view(got[0]) == ("HSS", 100, "ip_mapping", "Conflicting detection signals")
    assert view(got[1]) == ("SGW", 90, "subnet_mapping", "Protocol-port heuristic is ambiguous (SGW/PGW/MME)")
    assert view(got[2]) == ("HSS", 80, "hostname_pattern", None)
    assert view(got[3]) == ("SGW", 50, "protocol", "Protocol-port heuristic is ambiguous (SGW/PGW/MME)")
    assert view(got[4]) == ("UPF", 50, "protocol", None)
    assert view(got[5]) == ("MME", 100, "ip_mapping", None)
    assert view(got[6]) == ("UPF", 100, "manual_override", None)
    nothing = resolved(spark, ep.Lookups(), ("10.0.0.1",), ("10.0.0.1", 9))
    assert nothing[0].element_type is None and nothing[1].element_type == "unknown"


def test_last_named_occurrence_wins(spark, tables):
    data = [("c", 1, "10.0.0.2", 53, "9.9.9.9", 1), ("c", 2, "8.8.8.8", 1, "10.0.0.2", 2123)]
    df = spark.createDataFrame(data, "capture_id string, frame_no bigint, a string, ap int, b string, bp int")
    seen = ep.occurrences(df, ep.endpoint(F.col("a"), F.col("ap")), ep.endpoint(F.col("b"), F.col("bp")))
    out = ep.resolve(seen.select("endpoint"), tables)
    (peer,) = ep.resolved_peers(seen, out).collect()
    assert (peer.ip, peer.name, peer.network_element_type) == ("10.0.0.2", "AMF", "SGW")
    types = {r.name: r.packets for r in ep.element_overview(seen, out).where("facet = 'type'").collect()}
    assert types == {"DNS": 1, "unknown": 2, "SGW": 1}
    ports = spark.range(1).select(ep.first_element_port(F.array(F.lit(9), F.lit(None), F.lit(9), F.lit(53), F.lit(3868))).alias("p")).first().p
    assert ports == 53


def test_element_type_from_observed_ports(spark):
    rows = spark.createDataFrame([("10.0.0.1", None, [9, 36412, 53]), ("10.0.0.2", 2123, [53]), ("10.0.0.3", None, None)], "ip string, port int, seen array<int>")
    ends = rows.select(ep.endpoint(F.col("ip"), F.col("port")).alias("endpoint"), "seen")
    # the ports are a column beside the endpoint, keyed by it
    seen = F.element_at(F.create_map(F.lit("10.0.0.1"), F.array(F.lit(9), F.lit(36412), F.lit(53)), F.lit("10.0.0.2"), F.array(F.lit(53))), F.col("ip"))
    got = {r.ip: r.kind for r in ep.resolve(ends, ep.Lookups(), observed_ports=seen).select("endpoint.ip", F.col("resolved.element_type").alias("kind")).collect()}
    assert got == {"10.0.0.1": "MME", "10.0.0.2": "SGW", "10.0.0.3": None}
