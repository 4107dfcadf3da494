"""Registered queries: each reads whole tables and returns plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import anomalies as an
from tracemill.operators import classify, decode, domains, enrichment, flow, pairing, ranking, selection, stats, summary, timing
from tracemill.operators import evidence as evidence_ops
from tracemill.operators import endpoints as ep
from tracemill.operators import privacy as pv
from tracemill.plans import views
from tracemill.session import cut_lineage, intermediate_path
from tracemill.sources import index as index_source
from tracemill.sources import packets as packet_source
from tracemill.sources import lookups as lookup_files
from tracemill.sources import sinks
from tracemill.streaming import windows
from tracemill.functions.pseudonym import sha_hex, sha_hex_list
from tracemill.functions.tables import PRIVACY_PROFILES
from tracemill.sources.profiles import builtin_profiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BURST_GAP = 120000.0
FIRST_N = 500


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def lte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet index with its top protocol."""
    return classify.with_top_protocol(views.packet_index(spark, sf_dir), builtin_profiles()["lte-core"])


def joined(col: str) -> F.Column:
    return F.array_join(col, ",").alias(col)


# ------------------------------------------------------------------ sources
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index export lines of the trace; one in eleven lines is cut short or has a bad frame number."""
    df = views.packet_index(spark, sf_dir)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    when = lambda name, c: F.when(F.col("transport") == name, text(c)).otherwise(F.lit(""))
    v6 = F.col("dst_ip").contains(":")
    cols = [
        F.when(F.col("frame_no") % 11 == 3, F.lit("x1")).otherwise(text("frame_no")),
        text("time_epoch"), F.array_join("protocols", ":"),
        text("src_ip"), F.when(v6, F.lit(" ")).otherwise(text("dst_ip")), F.lit(""), F.when(v6, text("dst_ip")).otherwise(F.lit("")),
        when("sctp", "src_port"), when("sctp", "dst_port"), when("sctp", "stream"),
        when("tcp", "src_port"), when("tcp", "dst_port"), when("tcp", "stream"),
        F.when(F.col("tcp_retransmission"), "1").otherwise(""), F.when(F.col("tcp_out_of_order"), "1").otherwise(""),
        when("udp", "src_port"), when("udp", "dst_port"), when("udp", "stream"),
        text("diameter_flags"), text("diameter_cmd_code"), F.lit(""), text("diameter_hop_by_hop_id"),
        F.lit(" "), text("diameter_result_code"), F.lit(""),
        text("gtpv2_message_type"), F.lit(""), text("gtpv2_seq_no"), F.lit(""), text("gtpv2_cause"),
    ]
    last = F.when(F.col("frame_no") % 11 != 5, text("dns_qry_name"))  # a null is left out, the line is short
    # explode keeps the reader's filter from being pushed into the line building
    return df.select("capture_id", F.explode(F.array(F.concat_ws("|", *cols, last))).alias("value"))


@query
def index_scan(spark, sf_dir):
    parsed = index_source.parse_index(index_lines(spark, sf_dir))
    return index_source.keep_valid(parsed).withColumn("protocols", F.array_join("protocols", ":"))


@query
def index_rejects(spark, sf_dir):
    return index_source.malformed_counts(index_source.parse_index(index_lines(spark, sf_dir)))


# ------------------------------------------------------------------ statistics
@query
def protocol_hist(spark, sf_dir):
    return stats.protocol_counts(lte_index(spark, sf_dir))


@query
def transport_hist(spark, sf_dir):
    return stats.transport_counts(views.packet_index(spark, sf_dir))


@query
def conversations(spark, sf_dir):
    return stats.conversations(lte_index(spark, sf_dir))


@query
def conversations_topk(spark, sf_dir):
    return stats.top_conversations(stats.conversations(lte_index(spark, sf_dir)))


@query
def top_protocols(spark, sf_dir):
    return stats.top_protocols(stats.protocol_counts(lte_index(spark, sf_dir)))


@query
def raw_protocols(spark, sf_dir):
    return stats.raw_protocols(views.packet_index(spark, sf_dir))


@query
def first_last(spark, sf_dir):
    return stats.span(views.packet_index(spark, sf_dir))


@query
def name_sample(spark, sf_dir):
    return stats.dns_names(views.packet_index(spark, sf_dir))


@query
def capture_meta(spark, sf_dir):
    meta = stats.capture_meta(lte_index(spark, sf_dir), builtin_profiles()["lte-core"].relevant)
    return meta.select(
        "capture_id", "packet_count", "first_packet_number", "last_packet_number", "first_seen_epoch", "last_seen_epoch",
        joined("relevant_protocols"), joined("raw_protocols"), joined("dns_qry_names"),
    )


# ------------------------------------------------------------------ selection and guards
@query
def first_n(spark, sf_dir):
    return selection.first_packets(views.packet_index(spark, sf_dir).select("capture_id", "frame_no", "src_ip"), FIRST_N)


@query
def selection_info(spark, sf_dir):
    return selection.selection_info(views.packet_index(spark, sf_dir), FIRST_N)


@query
def first_lines_per_order(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("capture_id"),
        F.expr("l_linenumber * 1000000000000000 + l_partkey * 1000000000 + cast(round(l_extendedprice * 100) as bigint)").alias("frame_no"),
        "l_extendedprice",
    )
    return selection.first_packets(lines, 2)


@query
def selected_frames(spark, sf_dir):
    df = lte_index(spark, sf_dir)
    chosen = selection.first_packets(df.where("top_protocol = 'diameter'").select("capture_id", "frame_no"), 200)
    return selection.selected_frames(df, chosen).select("capture_id", "frame_no", "top_protocol", "src_ip")


@query
def coverage(spark, sf_dir):
    df = views.packet_index(spark, sf_dir).select("capture_id", "frame_no")
    return selection.coverage(df, selection.first_packets(df, FIRST_N))


@query
def oversize(spark, sf_dir):
    return selection.oversize(views.packet_index(spark, sf_dir), 20, 10)


# ------------------------------------------------------------------ timing
@query
def gap_stats(spark, sf_dir):
    return timing.gap_stats(views.packet_index(spark, sf_dir), ["capture_id"])


@query
def gap_stats_per_stream(spark, sf_dir):
    return timing.gap_stats(views.packet_index(spark, sf_dir), ["capture_id", "stream"])


@query
def packet_gaps(spark, sf_dir):
    out = timing.gaps(views.packet_index(spark, sf_dir).select("capture_id", "frame_no", "time_rel_ms"), ["capture_id"])
    return out.select("capture_id", "frame_no", F.round("gap", 3).alias("gap"))


@query
def bursts(spark, sf_dir):
    return timing.bursts(views.packet_index(spark, sf_dir), ["capture_id"], max_gap=BURST_GAP)


# ------------------------------------------------------------------ anomalies
@query
def transport_anomalies(spark, sf_dir):
    return an.transport_anomalies(views.packet_index(spark, sf_dir))


@query
def result_codes(spark, sf_dir):
    return an.result_code_anomalies(an.diameter_messages(views.packet_index(spark, sf_dir)))


@query
def duplicate_requests(spark, sf_dir):
    return an.duplicate_id_anomalies(an.linked_diameter(an.diameter_messages(views.packet_index(spark, sf_dir))))


@query
def unanswered_requests(spark, sf_dir):
    return an.unanswered_anomalies(an.linked_diameter(an.diameter_messages(views.packet_index(spark, sf_dir))))


@query
def gtp_anomalies(spark, sf_dir):
    return an.gtp_anomalies(views.packet_index(spark, sf_dir))


@query
def anomaly_counts(spark, sf_dir):
    return an.anomaly_counts(an.all_anomalies(views.packet_index(spark, sf_dir), "lte-core"))


# ------------------------------------------------------------------ endpoints
def trace_occurrences(spark, sf_dir):
    src, dst = views.endpoint_columns()
    return ep.occurrences(views.packet_index(spark, sf_dir), src, dst)


def resolved_endpoints(spark, sf_dir):
    return ep.resolve(trace_occurrences(spark, sf_dir).select("endpoint"), views.lookups(spark, sf_dir))


@query
def endpoint_resolve(spark, sf_dir):
    r = F.col("resolved")
    return resolved_endpoints(spark, sf_dir).select(
        "endpoint.ip", "endpoint.port", F.col("endpoint.point_code").alias("code"),
        r["hostname"].alias("hostname"), r["alias"].alias("alias"), r["role"].alias("role"), r["site"].alias("site"),
        r["labels"]["zone"].alias("zone"), r["labels"]["ss7_point_code_alias"].alias("code_alias"),
        r["element_type"].alias("element_type"), r["element_confidence"].alias("confidence"),
        r["element_source"].alias("source"), r["element_warning"].alias("warning"),
    )


@query
def cidr_match(spark, sf_dir):
    ips = trace_occurrences(spark, sf_dir).select("endpoint.ip").where("ip is not null").distinct()
    return ep.network_matches(ips, views.lookups(spark, sf_dir).subnets, "alias")


@query
def packet_endpoints(spark, sf_dir):
    src, dst = views.endpoint_columns()
    named = ep.attach(views.packet_index(spark, sf_dir), views.lookups(spark, sf_dir), src, dst)
    return named.select(
        "capture_id", "frame_no",
        F.col("src.alias").alias("src_alias"), F.col("src.element_type").alias("src_element"), F.col("src.role").alias("src_role"),
        F.col("dst.alias").alias("dst_alias"), F.col("dst.element_type").alias("dst_element"), F.col("dst.role").alias("dst_role"),
    )


@query
def resolved_peers(spark, sf_dir):
    peers = ep.resolved_peers(trace_occurrences(spark, sf_dir), resolved_endpoints(spark, sf_dir))
    return peers.select(
        "capture_id", "ip", "name", "hostname", "role", "network_element_type", "network_element_source", "ss7_point_code_alias"
    )


@query
def conversation_names(spark, sf_dir):
    peers = ep.resolved_peers(trace_occurrences(spark, sf_dir), resolved_endpoints(spark, sf_dir))
    return stats.attach_names(stats.conversations(lte_index(spark, sf_dir)), peers)


@query
def element_overview(spark, sf_dir):
    return ep.element_overview(trace_occurrences(spark, sf_dir), resolved_endpoints(spark, sf_dir))


# ------------------------------------------------------------------ privacy
def text_leaves(spark, sf_dir):
    """Every text of the tables as a leaf with a path."""
    part = lambda name, key, path, value: views.table(spark, sf_dir, name).selectExpr(
        f"'{name}' as capture_id", f"cast({key} as string) as leaf", f"{path} as path", f"{value} as value"
    )
    return (
        part("documents", "doc_id", "'message.fields.note'", "text")
        .unionByName(part("pages", "page_id", "'message.fields.link'", "url"))
        .unionByName(part("pages", "page_id", "'message.fields.page'", "html"))
        .unionByName(part("conversations", "concat(conv_id, '-', turn)", "if(turn % 2 = 0, 'message.body', 'message.fields.info')", "text"))
        .unionByName(part("customer", "c_custkey", "'message.fields.origin-host'", "c_name"))
        .unionByName(part("supplier", "s_suppkey", "'message.fields.diameter.origin_realm'", "s_name"))
        .unionByName(part("nation", "n_nationkey", "'message.fields.gtpv2.apn'", "n_name"))
    )


def classified_leaves(spark, sf_dir):
    return pv.classify_leaves(text_leaves(spark, sf_dir))


def subscriber_leaves(spark, sf_dir):
    """Subscriber, telephone and device numbers made of the customer keys."""
    rows = views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """explode(map(
          'imsi', concat(array('26201', '310410', '20801', '2620')[c_custkey % 4], lpad(cast(c_custkey as string), 9, '0')),
          'msisdn', concat(array('+49151', '49171', '+1', '+351', '0', '+4930')[c_custkey % 6], lpad(cast(c_custkey as string), 8, '0')),
          'imei', concat(array('35', '3587', '12')[c_custkey % 3], if(c_custkey % 7 = 0, '1', lpad(cast(c_custkey as string), 10, '0')))
        )) as (path, value)""",
    )
    return pv.classify_leaves(rows)


@query
def leaf_classify(spark, sf_dir):
    return classified_leaves(spark, sf_dir).select("capture_id", "leaf", "data_class")


@query
def protect_share(spark, sf_dir):
    out = pv.protect_leaves(classified_leaves(spark, sf_dir), PRIVACY_PROFILES["share"], digest=sha_hex)
    return out.select("capture_id", "leaf", F.md5("protected").alias("protected"))


@query
def protect_lab(spark, sf_dir):
    out = pv.protect_leaves(classified_leaves(spark, sf_dir), {**PRIVACY_PROFILES["lab"], "diameter_identity": "remove"})
    return out.groupBy("capture_id", "data_class").agg(
        F.count("*").alias("leaves"), F.count_if(F.col("protected") == "[redacted]").alias("masked")
    )


@query
def keep_prefix(spark, sf_dir):
    modes = {"imsi": "keep_mcc_mnc_mask_msin", "msisdn": "keep_cc_ndc_mask_subscriber", "imei": "keep_tac_mask_serial"}
    return pv.protect_leaves(subscriber_leaves(spark, sf_dir), modes).select("c_custkey", "path", "protected")


@query
def keep_prefix_pseudonym(spark, sf_dir):
    modes = {"imsi": "keep_mcc_mnc_pseudonymize_msin", "msisdn": "keep_cc_ndc_pseudonymize_subscriber", "imei": "keep_cc_ndc_mask_subscriber"}
    numbering = pv.Numbering(imsi_mnc_lengths={"208": 3}, msisdn_ndc_lengths={"351": 2})
    out = pv.protect_leaves(subscriber_leaves(spark, sf_dir), modes, numbering=numbering, digest=sha_hex)
    return out.select("c_custkey", "path", "protected")


@query
def pseudonym_sha(spark, sf_dir):
    modes = {"diameter_identity": "pseudonymize", "hostname": "pseudonymize", "apn_dnn": "pseudonymize"}
    return pv.pseudonym_map(classified_leaves(spark, sf_dir), modes, digest=sha_hex)


@query
def pseudonym_blake(spark, sf_dir):
    modes = {"diameter_identity": "pseudonymize", "hostname": "pseudonymize", "apn_dnn": "pseudonymize"}
    return pv.pseudonym_map(classified_leaves(spark, sf_dir), modes)


@query
def pseudonym_forms(spark, sf_dir):
    """What SQL can check of the keyed digests: every original once, one alias each, of the stated form."""
    found = pseudonym_blake(spark, sf_dir)
    form = F.col("alias").rlike("^[A-Z_]+_[0-9a-f]{8}$") & F.startswith("alias", F.concat(F.upper("data_class"), F.lit("_")))
    return found.groupBy("data_class", "original").agg(F.every(form).alias("well_formed"), F.countDistinct("alias").cast("int").alias("aliases"))


@query
def pseudonym_audit(spark, sf_dir):
    modes = PRIVACY_PROFILES["share"]
    return pv.pseudonym_audit(pv.pseudonym_map(classified_leaves(spark, sf_dir), modes, digest=sha_hex))


@query
def pseudonym_collisions(spark, sf_dir):
    modes = {"imsi": "pseudonymize", "msisdn": "pseudonymize", "imei": "pseudonymize"}
    mapping = pv.pseudonym_map(subscriber_leaves(spark, sf_dir), modes, digest=sha_hex, digest_bytes=1)
    return pv.pseudonym_collisions(mapping)


@query
def encrypt_roundtrip(spark, sf_dir):
    out = pv.protect_leaves(subscriber_leaves(spark, sf_dir), {"imsi": "encrypt", "msisdn": "mask"}, key=F.lit("0123456789abcdef"))
    plain = F.expr("if(path = 'imsi', cast(aes_decrypt(unbase64(protected), '0123456789abcdef', 'GCM') as string), protected)")
    return out.select("c_custkey", "path", plain.alias("plain"), (F.col("protected") != F.col("value")).alias("changed"))


@query
def leak_audit(spark, sf_dir):
    return pv.leak_audit(classified_leaves(spark, sf_dir), PRIVACY_PROFILES["lab"])


@query
def protect_deep(spark, sf_dir):
    """Whole texts and pages below twenty nested keys: depth must not change what is protected."""
    tree = lambda name, key, value: views.table(spark, sf_dir, name).selectExpr(
        f"'{name}' as capture_id", f"cast({key} as string) as id",
        f"concat(repeat('{{\"z\":', 19), to_json(named_struct('note', {value})), repeat('}}', 19)) as layers",
    )
    packets = tree("documents", "doc_id", "text").unionByName(tree("pages", "page_id", "html"))
    leaves = packet_source.leaf_table(packet_source.with_leaves(packets), "capture_id", "id")
    out = pv.protect_leaves(pv.classify_leaves(leaves, is_text="is_text"), PRIVACY_PROFILES["share"], digest=sha_hex)
    return out.select("capture_id", F.col("id").alias("leaf"), "depth", F.md5("protected").alias("protected"))


@query
def canonical_classes(spark, sf_dir):
    return pv.canonical_rollup(classified_leaves(spark, sf_dir))


# ------------------------------------------------------------------ full packets
def opened_packets(spark, sf_dir):
    return packet_source.with_leaves(views.trace_packets(spark, sf_dir))


def normal_packets(spark, sf_dir, profile="lte-core"):
    return decode.normalise(opened_packets(spark, sf_dir), builtin_profiles()[profile])


@query
def packet_rejects(spark, sf_dir):
    """Packet lines of the trace, some of them cut short, without layers, or with layers that are no object."""
    line = (
        "case when frame_no % 17 = 3 then left(layers, length(layers) - 2) when frame_no % 19 = 4 then '{\"_source\":{}}'"
        " when frame_no % 23 = 5 then '{\"_source\":{\"layers\":\"text\"}}' else concat('{\"_source\":{\"layers\":', layers, '}}') end as value"
    )
    numbered = views.trace_packets(spark, sf_dir, "frame_no")
    return packet_source.reject_counts(*packet_source.parse_packets(numbered.selectExpr("capture_id", line)))


@query
def packet_leaves(spark, sf_dir):
    """Leaves of all packets, counted per layer and path with the digits of list positions left out."""
    leaves = packet_source.leaf_table(opened_packets(spark, sf_dir), "capture_id")
    return leaves.groupBy("capture_id", "top", "path", "depth", "in_list", "is_text").agg(
        F.count("*").alias("leaves"), F.min("value").alias("smallest"), F.countDistinct("value").alias("values")
    )


@query
def normalised_packets(spark, sf_dir):
    return normal_packets(spark, sf_dir).select(
        "capture_id", "packet_no", F.round("time_rel_ms", 6).alias("time_rel_ms"), "time_epoch", "top_protocol",
        F.array_join("frame_protocols", ":").alias("stack"), "src_ip", "dst_ip", "transport.proto", "transport.src_port",
        "transport.dst_port", "transport.stream", "transport.anomaly", F.array_join("transport.notes", ";").alias("notes"), "is_valid",
    )


@query
def message_fields(spark, sf_dir):
    rows = normal_packets(spark, sf_dir).select("capture_id", "packet_no", F.explode(decode.field_map()).alias("path", "value"))
    return rows.groupBy("capture_id", "path").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query
def verbatim_fields(spark, sf_dir):
    rows = normal_packets(spark, sf_dir, "lte-s6a").where("top_protocol = 'diameter'")
    rows = rows.select("capture_id", "packet_no", F.explode(decode.field_map()).alias("path", "value"))
    return rows.groupBy("capture_id", "path").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query
def deep_fields(spark, sf_dir):
    rows = opened_packets(spark, sf_dir)
    return rows.select(
        "capture_id",
        F.expr(decode.field("frame.number")).cast("bigint").alias("packet_no"),
        F.expr(decode.deep_field(["gtpv2.cause", "dns.flags.rcode", "nas_eps.message_type"])).alias("found"),
        F.expr(decode.field("diameter.avp")).alias("avp"),
    )


def access_normal(spark, sf_dir):
    return decode.normalise(packet_source.with_leaves(views.access_packets(spark, sf_dir)), builtin_profiles()["vonr-ims-core"])


@query
def access_packets(spark, sf_dir):
    """Addresses of both families, point codes of either layer, one-item lists."""
    return access_normal(spark, sf_dir).select(
        "capture_id", "packet_no", "top_protocol", "src_ip", "dst_ip", "src_point_code", "dst_point_code", "transport.proto", "transport.src_port", "is_valid"
    )


@query
def access_fields(spark, sf_dir):
    """Message fields with repeated keys and nested codes."""
    rows = access_normal(spark, sf_dir).select("capture_id", F.explode(decode.field_map()).alias("path", "value"))
    return rows.groupBy("capture_id", "path", "value").agg(F.count("*").alias("n"))


@query
def whitelist_fields(spark, sf_dir):
    """Fields that a whitelist keeps although they lie outside the layer of their protocol."""
    lists = {"vonr-ims-core": {"ngap": ["ipv6.src", "sctp.srcport"], "sip": ["udp.dstport", "frame.number"]}}
    rows = decode.normalise(packet_source.with_leaves(views.access_packets(spark, sf_dir)), builtin_profiles(lists)["vonr-ims-core"])
    kept = rows.where("top_protocol in ('ngap', 'sip')").select("capture_id", "packet_no", F.explode(decode.field_map()).alias("path", "value"))
    return kept.where("path not like 'ngap.%' and path <> 'message_name'")


@query
def listed_fields(spark, sf_dir):
    """Flat fields, and fields of other layers, that the built-in lists keep."""
    rows = decode.normalise(packet_source.with_leaves(views.flat_packets(spark, sf_dir)), builtin_profiles()["2g3g-ss7-geran"])
    return rows.select("capture_id", "packet_no", "top_protocol", F.explode(decode.field_map()).alias("path", "value"))


@query
def reduced_transport(spark, sf_dir):
    """The transport fields that three profiles keep; the packets are decoded once for all of them."""
    packets = cut_lineage(access_normal(spark, sf_dir).select("capture_id", "transport"))
    parts = []
    for name in ("lte-s6a", "volte-sip", "2g3g-gn"):
        rows = decode.reduce_transport(packets, builtin_profiles()[name].transport_fields)
        shown = F.to_json("transport", {"ignoreNullFields": "false"})
        parts.append(rows.groupBy("capture_id", F.lit(name).alias("profile"), F.json_object_keys(shown).alias("kept")).agg(F.count("*").alias("packets")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("kept", F.array_join("kept", ","))


def access_flow(spark, sf_dir):
    end = lambda side: F.expr(f"struct({side}_ip as ip, cast(null as string) as hostname, cast(null as string) as alias, cast(null as string) as role)")
    return access_normal(spark, sf_dir).withColumn("src", end("src")).withColumn("dst", end("dst"))


@query
def access_labels(spark, sf_dir):
    """Names and status of NGAP, 5GS and named messages."""
    return flow.flow_packets(access_flow(spark, sf_dir)).select("capture_id", "packet_no", "message_name", "status")


@query
def access_phases(spark, sf_dir):
    """Phases by the rules of the 5G and of the voice family."""
    events = flow.flow_events(access_flow(spark, sf_dir), max_events=0)
    events = cut_lineage(events.select("capture_id", "event_no", "message_name", "status"))  # what phases read
    parts = [flow.phases(events, name).withColumn("profile", F.lit(name)) for name in ("5g-n2", "vonr-ims-core")]
    return parts[0].unionByName(parts[1])


@query
def hostname_resolve(spark, sf_dir):
    """Endpoints known by name only, in any spelling."""
    index = views.packet_index(spark, sf_dir).where("dns_qry_name is not null")
    names = views.lookups(spark, sf_dir)
    named = index.select(ep.endpoint(F.lit(None).cast("string"), hostname=F.concat(F.lit("MME-"), F.regexp_extract("dns_qry_name", "[0-9]+", 0))).alias("endpoint")).distinct()
    return ep.resolve(named, names).select(
        "endpoint.hostname", F.col("resolved.alias").alias("alias"), F.col("resolved.role").alias("role"), F.col("resolved.element_type").alias("element_type"),
        F.col("resolved.element_source").alias("source"),
    )


@query
def detection_gate(spark, sf_dir):
    """Element types are looked for only where something speaks for one: without lookups, a name or a port."""
    src = ep.endpoint(F.col("src_ip"))
    dst = ep.endpoint(F.col("dst_ip"), F.when(F.col("frame_no") % 2 == 0, F.col("dst_port")))
    seen = ep.occurrences(views.packet_index(spark, sf_dir), src, dst)
    found = ep.resolve(seen.select("endpoint"), ep.Lookups())
    return found.groupBy(F.col("endpoint.port").alias("port"), F.col("resolved.element_type").alias("element_type"), F.col("resolved.element_source").alias("source")).agg(
        F.countDistinct("endpoint.ip").alias("addresses")
    )


# ------------------------------------------------------------------ flow
def flow_input(spark, sf_dir):
    end = lambda side: F.expr(
        f"struct({side}_ip as ip, cast(null as string) as hostname,"
        f" if({side}_ip = '192.168.0.1', 'core-1', null) as alias, if(startswith({side}_ip, '192.'), 'mme', 'enb') as role)"
    )
    return normal_packets(spark, sf_dir).withColumn("src", end("src")).withColumn("dst", end("dst"))


def labelled_packets(spark, sf_dir):
    """All packets with their labels, decoded once and written, for what reads them more than once."""
    return cut_lineage(flow.flow_packets(flow_input(spark, sf_dir)))


def all_events(spark, sf_dir):
    return flow.flow_events(flow_input(spark, sf_dir), max_events=0)


@query
def message_labels(spark, sf_dir):
    return flow.flow_packets(flow_input(spark, sf_dir)).select(
        "capture_id", "packet_no", "message_name", "status", "correlation_id", "src_node", "dst_node"
    )


@query
def flow_events(spark, sf_dir):
    return all_events(spark, sf_dir).select(
        "capture_id", "event_no", "first_packet_no", "last_packet_no", "src_node", "dst_node", "message_name", "status",
        "correlation_id", "detail_label", "repeat_count", F.round("last_relative_ms", 6).alias("last_relative_ms"),
    )


@query
def flow_capped(spark, sf_dir):
    return flow.flow_events(flow_input(spark, sf_dir)).select("capture_id", "event_no", "first_packet_no", "message_name", "repeat_count")


@query
def event_refs(spark, sf_dir):
    return flow.event_refs(flow.numbered(labelled_packets(spark, sf_dir)))


def events_for_pairing(spark, sf_dir):
    """Pairing input straight from the event table, without decoding packets."""
    return views.trace_base(spark, sf_dir).selectExpr(
        "capture_id",
        "frame_no as event_no",
        "event_type as protocol",
        "if(k % 10 < 3, null, concat('id:', k div 20)) as correlation_id",
        "concat(array('Alpha', 'Beta', 'Gamma')[user_id % 3], if(k % 2 = 0, ' Request', ' Response')) as message_name",
        "if(k % 2 = 0, 'request', if(k % 7 = 0, 'error', 'response')) as status",
        "if(k % 2 = 0, concat('a', user_id % 2), concat('b', k % 3)) as src_node",
        "if(k % 2 = 0, concat('b', k % 3), concat('a', user_id % 2)) as dst_node",
        "k % 2 = 0 as is_request",
        "k % 2 = 1 as is_response",
    )


@query
def fifo_pairs(spark, sf_dir):
    rows = views.trace_base(spark, sf_dir).selectExpr(
        "capture_id", "user_id", "frame_no", "event_type in ('view', 'signup') as asks"
    ).where("event_type in ('view', 'signup', 'click', 'purchase')")
    return pairing.fifo_pairs(rows, ["capture_id", "user_id"], "frame_no", "asks")


@query
def paired_events(spark, sf_dir):
    return pairing.pair_events(events_for_pairing(spark, sf_dir))


@query
def paired_in_order(spark, sf_dir):
    """Pairs as a walk through the events finds them, some requests by id and by name."""
    return pairing.pair_events(events_for_pairing(spark, sf_dir), order="events")


@query
def pair_write_back_in_order(spark, sf_dir):
    events = events_for_pairing(spark, sf_dir)
    return pairing.write_back(events, pairing.pair_events(events, order="events")).select(
        "capture_id", "event_no", "status", "is_request", "is_response", "paired_event_id"
    )


@query
def pair_write_back(spark, sf_dir):
    events = events_for_pairing(spark, sf_dir)
    return pairing.write_back(events, pairing.pair_events(events)).select(
        "capture_id", "event_no", "status", "is_request", "is_response", "paired_event_id"
    )


@query
def flow_phases(spark, sf_dir):
    return flow.phases(all_events(spark, sf_dir), "lte-core")


@query
def flow_nodes(spark, sf_dir):
    return flow.nodes(flow.flow_packets(flow_input(spark, sf_dir)), "lte-core")


@query
def flow_totals(spark, sf_dir):
    packets = labelled_packets(spark, sf_dir)
    shown = flow.capped(packets)
    return flow.totals(packets, shown, flow.flow_events(packets))


@query
def collapse_turns(spark, sf_dir):
    """Runs of turns with the same role in each conversation."""
    turns = views.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as capture_id", "turn as packet_no", "cast(turn as double) as time_rel_ms", "cast(turn as string) as time_epoch",
        "'chat' as top_protocol", "cast(array() as array<string>) as anomalies", "role as src_node", "'x' as dst_node",
        "if(turn % 3 = 0, 'a', 'b') as message_name", "'request' as status", "cast(null as string) as correlation_id",
    )
    return flow.event_rows(flow.numbered(turns)).select(
        F.col("capture_id").alias("conv_id"), "event_no", "src_node", "message_name", "first_packet_no", "last_packet_no", "repeat_count"
    )


# ------------------------------------------------------------------ evidence, domains, ranking
def mix_parts(spark, sf_dir):
    df = views.mix_index(spark, sf_dir)
    totals = df.groupBy("capture_id").agg(F.count("*").alias("total_packets"))
    peers = df.where("name is not null").select("capture_id", "name", "role").distinct()
    dns = peers.select("capture_id", "name").distinct()
    return totals, stats.protocol_counts(df), stats.transport_counts(df), stats.raw_protocols(df), peers, dns


def mix_captures(spark, sf_dir):
    """Evidence per capture, written once: one small row per capture that every rule reads."""
    return cut_lineage(domains.with_domains(cut_lineage(evidence_ops.capture_evidence(*mix_parts(spark, sf_dir)))))


@query
def ranking_evidence(spark, sf_dir):
    totals, counts, transports, raw, _, _ = mix_parts(spark, sf_dir)
    return evidence_ops.evidence(counts, transports, raw, totals)


@query
def signalling_evidence(spark, sf_dir):
    totals, counts, transports, raw, _, _ = mix_parts(spark, sf_dir)
    return evidence_ops.evidence(counts, transports, raw, totals, signalling=True)


@query
def naming_evidence(spark, sf_dir):
    _, _, _, _, peers, dns = mix_parts(spark, sf_dir)
    out = evidence_ops.naming_evidence(evidence_ops.naming_words(dns, peers))
    return out.withColumn("naming_reasons", F.array_join("naming_reasons", "; "))


@query
def domain_infer(spark, sf_dir):
    rows = domains.domain_rows(evidence_ops.capture_evidence(*mix_parts(spark, sf_dir)))
    return rows.select("capture_id", "rank", "domain", "score", "role")


@query
def dominant_signalling(spark, sf_dir):
    return domains.dominant_signalling(mix_captures(spark, sf_dir))


@query
def relevant_signalling(spark, sf_dir):
    return domains.relevant_signalling(mix_captures(spark, sf_dir))


@query
def capture_context(spark, sf_dir):
    out = domains.capture_context(mix_captures(spark, sf_dir))
    return out.select("capture_id", joined("link_or_envelope_protocols"), joined("transport_support_protocols"))


def mix_scored(spark, sf_dir):
    return ranking.score_profiles(mix_captures(spark, sf_dir), builtin_profiles().values())


@query
def profile_base_scores(spark, sf_dir):
    rows = ranking.base_scores(ranking.with_profiles(mix_captures(spark, sf_dir), builtin_profiles().values()))
    return rows.where("not naming and base > 0").select("capture_id", "profile", F.round("base", 4).alias("base"))


@query
def profile_rank(spark, sf_dir):
    return ranking.recommended(mix_scored(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "; "))


@query
def profile_suppressed(spark, sf_dir):
    return ranking.suppressed(mix_scored(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "; "))


@query
def best_profile(spark, sf_dir):
    captures = mix_captures(spark, sf_dir)
    scored = ranking.score_profiles(captures, builtin_profiles().values())
    return ranking.best_profile(captures, ranking.recommended(scored))


@query
def trace_shape(spark, sf_dir):
    rows = enrichment.with_shape(mix_captures(spark, sf_dir))
    return rows.select("capture_id", "trace_shape", F.array_join("trace_shape_reasons", "; ").alias("why"), "signalling", "counted")


@query
def capture_enrichment(spark, sf_dir):
    captures = mix_captures(spark, sf_dir)
    ranked = ranking.recommended(ranking.score_profiles(captures, builtin_profiles().values()), 6)
    rows = enrichment.enrich(captures, ranked)
    return rows.select(
        "capture_id", "trace_shape", "classification_state", F.array_join("network_anomalies", "; ").alias("network_anomalies"),
        F.array_join("classification_notes", "; ").alias("classification_notes"), F.array_join("next_step_hints", "; ").alias("next_step_hints"),
    )


@query
def discovery_union(spark, sf_dir):
    """Top protocols of the trace under the union of all profiles."""
    from tracemill.sources.profiles import discovery_profile

    df = classify.with_top_protocol(views.packet_index(spark, sf_dir), discovery_profile(builtin_profiles().values()))
    return stats.protocol_counts(df)


# ------------------------------------------------------------------ summaries and artifacts
@query
def findings(spark, sf_dir):
    df = lte_index(spark, sf_dir)
    layers = an.anomaly_counts(an.all_anomalies(df, "lte-core"))
    gaps = timing.gap_stats(df, ["capture_id"])
    runs = timing.bursts(df, ["capture_id"], max_gap=BURST_GAP)
    return summary.findings(layers, stats.protocol_counts(df), gaps, runs)


def summary_of(df, modes):
    """Summary rows of an index: four scans, for the cells, the conversations, the detail window and the anomalies."""
    profile = builtin_profiles()["lte-core"]
    base = cut_lineage(stats.cells(df))
    chosen = cut_lineage(selection.first_packets(df.select("capture_id", "frame_no", "time_rel_ms", "top_protocol"), FIRST_N))
    counts = stats.protocol_counts(chosen)
    layers = cut_lineage(an.anomaly_counts(an.all_anomalies(df, profile.name)))
    gaps, runs = timing.gap_stats(chosen, ["capture_id"]), timing.bursts(chosen, ["capture_id"], max_gap=BURST_GAP)
    return summary.summary_rows(
        stats.capture_meta(base, profile.relevant), stats.top_conversations(stats.conversations(df)), counts, stats.transport_counts(base),
        layers, summary.findings(layers, counts, gaps, runs), selection.coverage(base, chosen), gaps, profile.name, modes,
    )


@query
def capture_summary(spark, sf_dir):
    rows = summary_of(lte_index(spark, sf_dir), PRIVACY_PROFILES["share"])
    pairs = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.select(
        "capture_id", "packet_message_counts.total_packets", pairs("packet_message_counts.top_protocols").alias("top_protocols"),
        pairs("packet_message_counts.transport").alias("transport"), pairs("anomaly_counts_by_layer").alias("layers"),
        F.size("conversations").alias("conversations"), F.col("coverage.detail_truncated").alias("truncated"),
        F.size("deterministic_findings").alias("findings"), F.size("privacy_modes").alias("modes"),
        F.col("timing_stats.packet_count").alias("timed"),
    )


@query
def quality_warnings(spark, sf_dir):
    df = lte_index(spark, sf_dir)
    cover = selection.coverage(df, selection.first_packets(df, FIRST_N))
    relevant = stats.sorted_lists(stats.relevant_protocols(stats.protocol_counts(df), ["sip"]), "protocol", "relevant_protocols")
    rows = cover.select("capture_id", F.struct("detail_truncated", "truncation_note").alias("coverage")).join(relevant, "capture_id", "left")
    return summary.quality_warnings(rows, pseudonyms=True)


@query
def message_excerpt(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("capture_id"), F.col("turn").alias("packet_no"), "role", "text")
    return summary.excerpt(turns, 3)


@query
def artifact_names(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat(' ', event_type, ' (', user_id, ')..', props, '-') as stem",
        "if(event_id % 3 = 0, null, if(event_id % 3 = 1, cast(unix_seconds(cast(ts as timestamp)) as string), concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '.123456789Z'))) as first_seen",
    )
    return rows.selectExpr("event_id", f"{summary.artifact_prefix('analyze', 'stem', 'first_seen', 'event_id')} as prefix")


@query
def next_versions(spark, sf_dir):
    names = views.table(spark, sf_dir, "events").selectExpr(
        "concat('analyze_u', user_id, '_V_', 1 + (event_id * 7) % 23, if(event_id % 2 = 0, '_detail', ''), if(event_type = 'error', '.txt', '.json')) as name"
    )
    return summary.next_versions(summary.parse_artifacts(names))


@query
def batch_overview(spark, sf_dir):
    packets = labelled_packets(spark, sf_dir)
    events = cut_lineage(flow.flow_events(packets, max_events=0))
    linked = pairing.write_back(events, pairing.pair_events(events))
    return flow.overview(linked, flow.nodes(packets, "lte-core"), flow.phases(linked, "lte-core"))


@query
def status_counts(spark, sf_dir):
    df = views.packet_index(spark, sf_dir)
    per_stream = df.groupBy("capture_id", "stream").agg(F.count("*").alias("n"), F.count_if("tcp_retransmission").alias("bad"))
    return summary.status_counts(per_stream.selectExpr("case when bad > 5 then 'failed' when n < 50 then 'skipped' else 'ok' end as status"))


@query
def protected_packets(spark, sf_dir):
    """Every packet with its texts protected: identities hashed away, telephone-like numbers masked, uris removed."""
    end = lambda s: F.expr(f"struct({s}_ip as ip, concat('node-', {s}_ip) as hostname, 'core' as alias, 'mme' as role, cast(null as string) as site, map('zone', {s}_ip) as labels)")
    packets = normal_packets(spark, sf_dir).withColumn("src", end("src")).withColumn("dst", end("dst"))
    modes = {"ip": "mask", "payload_text": "mask", "imsi": "keep_mcc_mnc_mask_msin", "hostname": "remove", "apn_dnn": "mask"}
    rows = pv.protect_packets(packets, modes)
    return rows.select(
        "capture_id", "packet_no", "top_protocol", "time_epoch", F.col("src.ip").alias("src_ip"), F.col("src.hostname").alias("src_name"),
        F.col("src.alias").alias("src_alias"), F.col("dst.labels")["zone"].alias("dst_zone"), "transport.stream",
        F.expr("array_join(transform(fields, l -> concat(l.path, '=', l.value)), ';')").alias("fields"),
    )


def reported_packets(spark, sf_dir, modes):
    """Packets with what the protecting pass issued and found."""
    end = lambda s: F.expr(f"struct({s}_ip as ip, concat('node-', {s}_ip) as hostname, 'core' as alias, 'mme' as role, cast(null as string) as site, map('zone', {s}_ip) as labels)")
    packets = normal_packets(spark, sf_dir).withColumn("src", end("src")).withColumn("dst", end("dst"))
    return pv.protect_packets(packets, modes, report="report", digest_list=sha_hex_list)


@query
def packet_pseudonyms(spark, sf_dir):
    modes = {"ip": "pseudonymize", "hostname": "pseudonymize", "apn_dnn": "pseudonymize", "imsi": "keep_mcc_mnc_pseudonymize_msin", "payload_text": "mask"}
    return pv.issued_pseudonyms(reported_packets(spark, sf_dir, modes))


@query
def packet_leaks(spark, sf_dir):
    modes = {**PRIVACY_PROFILES["internal"], "apn_dnn": "mask"}
    return pv.open_leaves(reported_packets(spark, sf_dir, modes), modes)


@query
def protected_summary(spark, sf_dir):
    """The conversations of the summary rows, protected like every text of a summary."""
    modes = {**PRIVACY_PROFILES["share"], "payload_text": "remove"}
    hidden = pv.protect_payload(summary_of(lte_index(spark, sf_dir), modes), modes, digest_list=sha_hex_list)
    return hidden.select(
        "capture_id", F.col("capture_metadata.first_seen_epoch").alias("first_seen"), F.posexplode("conversations").alias("place", "c")
    ).select("capture_id", "first_seen", "place", "c.transport", "c.src", "c.dst", "c.packet_count")


@query
def summary_handoff(spark, sf_dir):
    """What is handed over of each capture: the protected summary as one text, read again, and the first packets beside it."""
    modes = {**PRIVACY_PROFILES["share"], "payload_text": "remove"}
    index = lte_index(spark, sf_dir)
    excerpts = summary.excerpt(index.selectExpr("capture_id", "frame_no as packet_no", "transport"), 3)
    handed = summary.handoff(summary_of(index, modes), excerpts, modes, digest_list=sha_hex_list)
    listed = F.from_json(F.get_json_object("summary", "$.conversations"), "array<struct<transport:string,src:string,dst:string,packet_count:bigint>>")
    rows = handed.select("*", F.get_json_object("summary", "$.profile").alias("profile"), F.posexplode(listed).alias("place", "c"))
    return rows.select("capture_id", "profile", "included_messages", "available_messages", "messages", "place", "c.*")


def lookup_file(spark, sf_dir, line: str):
    """The customers as lines of a lookup, with what such files hold besides, in text files that the query writes."""
    lines = views.table(spark, sf_dir, "customer").selectExpr(
        f"case c_custkey % 5 when 3 then '  # ' when 4 then concat('alone', c_custkey, '  ') else {line} end as line"
    )
    path = intermediate_path(spark)
    lines.write.text(path)
    return path


NETWORK = "concat('10.', c_custkey div 256 % 256, '.', c_custkey % 256, '.0')"


@query
def host_file(spark, sf_dir):
    path = lookup_file(spark, sf_dir, f"concat('\t', {NETWORK}, '  host-', c_custkey, ' further words')")
    return lookup_files.read_hosts(spark, path).select("ip", "hostname")


@query
def subnet_file(spark, sf_dir):
    path = lookup_file(spark, sf_dir, f"concat({NETWORK}, if(c_custkey % 7 = 0, '/99', '/24'), ' net of ', c_custkey, ' ')")
    return lookup_files.read_subnets(spark, path).select("cidr", "alias")


@query
def point_code_file(spark, sf_dir):
    path = lookup_file(spark, sf_dir, "concat('pc-', lower(hex(c_custkey)), '\t code ', c_custkey)")
    return lookup_files.read_point_codes(spark, path).select("point_code", "alias")


@query
def transport_notes(spark, sf_dir):
    """Transport anomalies as full packets show them."""
    return an.note_anomalies(normal_packets(spark, sf_dir).where("is_valid"))


@query
def replaced_index(spark, sf_dir):
    """The written index after one capture was written again without the packets of odd number."""
    index = views.packet_index(spark, sf_dir).select("capture_id", "frame_no", "time_epoch", "src_ip", "dst_ip", "transport")
    path = f"{intermediate_path(spark)}/index"
    sinks.replace_captures(index, path, "frame_no", buckets=8)
    sinks.replace_captures(index.where("capture_id = 'c1' AND frame_no % 2 = 0").withColumn("transport", F.upper("transport")), path, "frame_no", buckets=8)
    return spark.read.parquet(path).drop(sinks.BUCKET)


# ------------------------------------------------------------------ streams
def landed(spark: SparkSession, sf_dir: str, closing) -> DataFrame:
    """What a stream of the whole trace closes, from the sink it is written to."""
    index = classify.with_top_protocol(views.packet_index(spark, sf_dir, views.event_stream(spark, sf_dir)), builtin_profiles()["lte-core"])
    closed, folder = closing(index), intermediate_path(spark)
    query = windows.land(closed, f"{folder}/closed", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{folder}/closed")


def micros(*names: str) -> list[F.Column]:
    """Times as microseconds, equal in every engine."""
    return [F.unix_micros(n).alias(n) for n in names]


@query
def stream_protocol_windows(spark, sf_dir):
    rows = landed(spark, sf_dir, lambda index: windows.window_counts(index, windows.protocol_keys(), "6 hours"))
    return rows.select(*micros("window_start", "window_end"), "capture_id", "protocol", "packets", "first_frame")


@query
def stream_conversation_windows(spark, sf_dir):
    rows = landed(spark, sf_dir, lambda index: windows.window_counts(index, windows.conversation_keys(), "1 day"))
    return rows.select(*micros("window_start", "window_end"), "capture_id", "transport", "src", "dst", "top_protocol", "packets", "first_frame")


@query
def stream_bursts(spark, sf_dir):
    rows = landed(spark, sf_dir, lambda index: windows.session_bursts(index, BURST_GAP))
    return rows.select("capture_id", "packet_count", "first_frame", *micros("start", "end"))


@query
def stream_diameter_timeouts(spark, sf_dir):
    rows = landed(spark, sf_dir, lambda index: windows.diameter_timeouts(index, "6 hours"))
    return rows.select("capture_id", "frame_no", "hop_by_hop", "cmd", *micros("asked_at"))


@query
def stream_session_timeouts(spark, sf_dir):
    rows = landed(spark, sf_dir, lambda index: windows.session_timeouts(index, "6 hours"))
    return rows.select("capture_id", "frame_no", "seq", *micros("asked_at"))
