"""DuckDB SQL that states the expected result of the registered queries."""

from __future__ import annotations

from tracemill.plans import oracle_rank
from tracemill.plans.oracle_views import ACCESS, ENDPOINTS, EVENTS, PACKETS, PKT

ORACLE: dict[str, str] = {}


def pkt(sql: str) -> str:
    """``sql`` with the packet view in front; it may start with more CTEs after a comma."""
    return f"WITH {PKT}{sql}"


VALID = "frame_no % 11 <> 3 AND NOT (frame_no % 11 = 5)"
ORACLE["index_scan"] = pkt(f"""
SELECT capture_id, frame_no, time_epoch, stack AS protocols, src_ip, dst_ip, transport, src_port, dst_port, stream,
  tcp_retransmission, tcp_out_of_order, diameter_flags, diameter_cmd_code, diameter_hop_by_hop_id, diameter_result_code,
  gtpv2_message_type, gtpv2_seq_no, gtpv2_cause, dns_qry_name
FROM pkt WHERE {VALID}""")
ORACLE["index_rejects"] = pkt(f"""
SELECT capture_id, count(*) FILTER (WHERE {VALID}) AS kept, count(*) FILTER (WHERE NOT ({VALID})) AS dropped
FROM pkt GROUP BY 1""")
ORACLE["protocol_hist"] = pkt("""
SELECT capture_id, top_protocol AS protocol, count(*) AS packets, min(frame_no) AS first_frame FROM pkt GROUP BY 1, 2""")
ORACLE["transport_hist"] = pkt("""
SELECT capture_id, transport, count(*) AS packets, min(frame_no) AS first_frame FROM pkt GROUP BY 1, 2""")
CONVERSATIONS = """
SELECT capture_id, transport, coalesce(src_ip, 'unknown') AS src, coalesce(dst_ip, 'unknown') AS dst, top_protocol,
  count(*) AS packet_count, min(frame_no) AS first_frame FROM pkt GROUP BY 1, 2, 3, 4, 5"""
ORACLE["conversations"] = pkt(CONVERSATIONS)
ORACLE["conversations_topk"] = pkt(f"""
, conv AS ({CONVERSATIONS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY packet_count DESC, first_frame) AS rank FROM conv)
SELECT * FROM ranked WHERE rank <= 25""")
ORACLE["top_protocols"] = pkt("""
, n AS (SELECT capture_id, top_protocol AS protocol, count(*) AS packets, min(frame_no) AS first_frame FROM pkt GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY packets DESC, protocol) AS rank FROM n) WHERE rank <= 10""")
ORACLE["raw_protocols"] = pkt("""
SELECT DISTINCT capture_id, unnest(string_split(stack, ':')) AS protocol FROM pkt""")
SPAN = """
SELECT capture_id, count(*) AS packet_count, min(frame_no) AS first_packet_number, max(frame_no) AS last_packet_number,
  arg_min(time_epoch, frame_no) AS first_seen_epoch, arg_max(time_epoch, frame_no) AS last_seen_epoch
FROM pkt GROUP BY 1"""
ORACLE["first_last"] = pkt(SPAN)
NAMES = """
n AS (SELECT capture_id, lower(dns_qry_name) AS name, min(frame_no) AS first_frame FROM pkt WHERE dns_qry_name IS NOT NULL GROUP BY 1, 2),
sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY first_frame) AS rn FROM n) WHERE rn <= 30)"""
ORACLE["name_sample"] = pkt(f", {NAMES} SELECT capture_id, name, first_frame FROM sampled")
ORACLE["capture_meta"] = pkt(f"""
, {NAMES}, span AS ({SPAN}),
rel AS (SELECT capture_id, string_agg(DISTINCT top_protocol, ',' ORDER BY top_protocol) AS relevant_protocols FROM pkt GROUP BY 1),
raw AS (SELECT capture_id, string_agg(DISTINCT p, ',' ORDER BY p) AS raw_protocols
        FROM (SELECT capture_id, unnest(string_split(stack, ':')) AS p FROM pkt) GROUP BY 1),
dns AS (SELECT capture_id, string_agg(name, ',' ORDER BY name) AS dns_qry_names FROM sampled GROUP BY 1)
SELECT span.*, relevant_protocols, raw_protocols, dns_qry_names
FROM span JOIN rel USING (capture_id) JOIN raw USING (capture_id) JOIN dns USING (capture_id)""")
RANKED = "SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) AS rn FROM pkt"
ORACLE["first_n"] = pkt(f"SELECT capture_id, frame_no, src_ip FROM ({RANKED}) WHERE rn <= 500")
ORACLE["selection_info"] = pkt("""
SELECT capture_id, count(*) AS total_exported, least(count(*), 500) AS selected, count(*) > 500 AS truncated,
  CASE WHEN count(*) > 500 THEN format('detail.json contains only the first 500 of {:,} packets. Use --all-packets to include all.', count(*)) END AS truncation_note
FROM pkt GROUP BY 1""")
ORACLE["first_lines_per_order"] = """
WITH l AS (SELECT l_orderkey AS capture_id, l_extendedprice,
    l_linenumber * 1000000000000000 + l_partkey * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS frame_no FROM lineitem)
SELECT capture_id, frame_no, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) AS rn FROM l)
WHERE rn <= 2"""
ORACLE["selected_frames"] = pkt("""
SELECT capture_id, frame_no, top_protocol, src_ip FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) AS rn FROM pkt WHERE top_protocol = 'diameter') WHERE rn <= 200""")
ORACLE["coverage"] = pkt("""
SELECT capture_id, least(count(*), 500) AS detail_packets_included, count(*) AS detail_packets_available,
  count(*) AS summary_packet_count, count(*) > 500 AS detail_truncated,
  CASE WHEN count(*) > 500 THEN format('detail artifact contains 500 of {:,} exported packets.', count(*)) END AS truncation_note
FROM pkt GROUP BY 1""")
ORACLE["oversize"] = pkt("""
SELECT capture_id, count(*) AS total_exported, round(count(*) / 20.0::DOUBLE, 2) AS ratio FROM pkt GROUP BY 1 HAVING count(*) > 200""")


def gap_sql(keys: str) -> str:
    return pkt(f"""
, g AS (SELECT *, time_rel_ms - lag(time_rel_ms) OVER (PARTITION BY {keys} ORDER BY frame_no) AS gap FROM pkt),
r AS (SELECT {keys}, gap, row_number() OVER (PARTITION BY {keys} ORDER BY gap) AS rn, count(*) OVER (PARTITION BY {keys}) AS n
      FROM g WHERE gap IS NOT NULL),
p AS (SELECT {keys}, round(gap, 3) AS gap_p95 FROM r WHERE rn = CAST(floor((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1),
s AS (SELECT {keys}, count(*) AS packet_count, round(max(time_rel_ms) - min(time_rel_ms), 3) AS duration_ms,
        round(min(gap), 3) AS gap_min, round(max(gap), 3) AS gap_max,
        round((arg_max(time_rel_ms, frame_no) - arg_min(time_rel_ms, frame_no)) / nullif(count(*) - 1, 0), 3) AS gap_mean FROM g GROUP BY {keys})
SELECT * FROM s JOIN p USING ({keys}) WHERE packet_count >= 2""")


ORACLE["gap_stats"] = gap_sql("capture_id")
ORACLE["gap_stats_per_stream"] = gap_sql("capture_id, stream")
ORACLE["packet_gaps"] = pkt("""
SELECT capture_id, frame_no, round(time_rel_ms - lag(time_rel_ms) OVER (PARTITION BY capture_id ORDER BY frame_no), 3) AS gap FROM pkt""")
ORACLE["bursts"] = pkt("""
, g AS (SELECT *, time_rel_ms - lag(time_rel_ms) OVER (PARTITION BY capture_id ORDER BY frame_no) AS gap FROM pkt),
i AS (SELECT *, sum(CASE WHEN gap BETWEEN 0 AND 120000 THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id ORDER BY frame_no) AS run FROM g)
SELECT capture_id, count(*) AS packet_count, min(frame_no) AS first_frame, round(arg_min(time_rel_ms, frame_no), 3) AS start_ms,
  round(arg_max(time_rel_ms, frame_no), 3) AS end_ms FROM i GROUP BY capture_id, run HAVING count(*) >= 5""")

TRANSPORT_ANOMALIES = """
SELECT capture_id, 0 AS section, frame_no AS position, frame_no, 'transport' AS layer, CAST(NULL AS VARCHAR) AS severity, 'transport' AS kind,
  'Packet ' || frame_no || ': ' || concat_ws(', ', CASE WHEN tcp_retransmission THEN 'retransmission' END, CASE WHEN tcp_out_of_order THEN 'out_of_order' END) AS text
FROM pkt WHERE tcp_retransmission OR tcp_out_of_order"""
DIAMETER = """
dia AS (SELECT capture_id, frame_no, coalesce(diameter_flags, '') = '192' AS is_request, diameter_cmd_code AS cmd,
          diameter_hop_by_hop_id AS hbh, CAST(diameter_result_code AS BIGINT) AS code FROM pkt WHERE diameter_cmd_code IS NOT NULL),
linked AS (SELECT *, lag(is_request) OVER w AS before, lead(is_request) OVER w AS after FROM dia
           WINDOW w AS (PARTITION BY capture_id, hbh ORDER BY frame_no))"""
RESULT_CODES = """
SELECT capture_id, 1 AS section, frame_no AS position, frame_no, 'diameter' AS layer, CASE WHEN code >= 5000 THEN 'error' ELSE 'warn' END AS severity,
  'result_code' AS kind, '[diameter][' || CASE WHEN code >= 5000 THEN 'error' ELSE 'warn' END || '] Result-Code ' || code || ' (cmd=' || cmd || ') at packet ' || frame_no AS text
FROM dia WHERE NOT is_request AND code IS NOT NULL AND code NOT BETWEEN 2000 AND 2999"""
DUPLICATES = """
SELECT capture_id, 1 AS section, frame_no AS position, frame_no, 'diameter' AS layer, 'warn' AS severity, 'duplicate_id' AS kind,
  '[diameter][warn] Duplicate hop-by-hop ID ' || hbh || ' (cmd=' || cmd || ') at packet ' || frame_no AS text
FROM linked WHERE is_request AND before"""
UNANSWERED = """
SELECT capture_id, 2 AS section, opened AS position, frame_no, 'diameter' AS layer, 'warn' AS severity, 'unanswered' AS kind,
  '[diameter][warn] Unanswered request cmd=' || cmd || ' hop-by-hop=' || hbh || ' from packet ' || frame_no AS text
FROM (SELECT *, max(CASE WHEN is_request AND NOT coalesce(before, false) THEN frame_no END) OVER (PARTITION BY capture_id, hbh) AS opened FROM linked)
WHERE is_request AND after IS NULL"""
GTP = """
gtp AS (SELECT capture_id, frame_no, gtpv2_message_type AS type, gtpv2_seq_no AS seq,
          CASE WHEN gtpv2_cause = '0x49' THEN 73 ELSE CAST(gtpv2_cause AS INTEGER) END AS cause FROM pkt WHERE gtpv2_message_type IS NOT NULL),
glinked AS (SELECT *, lag(type) OVER w AS before, lead(type) OVER w AS after FROM gtp WHERE type IN ('32', '33')
           WINDOW w AS (PARTITION BY capture_id, seq ORDER BY frame_no))"""
GTP_ANOMALIES = """
SELECT capture_id, 3 AS section, frame_no AS position, frame_no, 'gtpv2' AS layer, 'warn' AS severity, 'rejected' AS kind,
  '[gtpv2][warn] Create Session rejected cause=' || cause || ' at packet ' || frame_no AS text FROM gtp WHERE type = '33' AND cause <> 16
UNION ALL
SELECT capture_id, 3, frame_no, frame_no, 'gtpv2', 'error', 'error_indication', '[gtpv2][error] Error Indication at packet ' || frame_no FROM gtp WHERE type = '26'
UNION ALL
SELECT capture_id, 4, opened, frame_no, 'gtpv2', 'warn', 'unanswered', '[gtpv2][warn] Unanswered Create Session Request seq=' || seq || ' from packet ' || frame_no
FROM (SELECT *, max(CASE WHEN type = '32' AND coalesce(before, '33') = '33' THEN frame_no END) OVER (PARTITION BY capture_id, seq) AS opened FROM glinked)
WHERE type = '32' AND after IS NULL"""
ORACLE["transport_anomalies"] = pkt(TRANSPORT_ANOMALIES)
ORACLE["result_codes"] = pkt(f", {DIAMETER} {RESULT_CODES}")
ORACLE["duplicate_requests"] = pkt(f", {DIAMETER} {DUPLICATES}")
ORACLE["unanswered_requests"] = pkt(f", {DIAMETER} {UNANSWERED}")
ORACLE["gtp_anomalies"] = pkt(f", {GTP} {GTP_ANOMALIES}")
ALL_ANOMALIES = f"{TRANSPORT_ANOMALIES} UNION ALL {RESULT_CODES} UNION ALL {DUPLICATES} UNION ALL {UNANSWERED} UNION ALL {GTP_ANOMALIES}"
ORACLE["anomaly_counts"] = pkt(f", {DIAMETER}, {GTP}, found AS ({ALL_ANOMALIES}) SELECT capture_id, layer, count(*) AS anomalies FROM found GROUP BY 1, 2")

ORACLE["endpoint_resolve"] = pkt(f", {ENDPOINTS} SELECT * FROM endpoints")
ORACLE["cidr_match"] = pkt("""
SELECT ip, r_name AS alias FROM (SELECT src_ip AS ip FROM pkt UNION SELECT dst_ip FROM pkt) JOIN region ON r_regionkey =
  CASE WHEN ip LIKE '10.1.%' THEN 0 WHEN ip LIKE '10.%' THEN 1 WHEN ip LIKE '192.168.0.%' OR ip LIKE '192.168.1.%' THEN 2 WHEN ip LIKE '2001:db8:%' THEN 3 END""")
SIDES = """
occ AS (SELECT s.capture_id, s.frame_no, s.side, e.* FROM sides s JOIN endpoints e
        ON e.ip IS NOT DISTINCT FROM s.ip AND e.port IS NOT DISTINCT FROM s.port AND e.code IS NOT DISTINCT FROM s.code)"""
ORACLE["packet_endpoints"] = pkt(f"""
, {ENDPOINTS}, {SIDES}
SELECT a.capture_id, a.frame_no, a.alias AS src_alias, a.element_type AS src_element, a.role AS src_role,
  b.alias AS dst_alias, b.element_type AS dst_element, b.role AS dst_role
FROM occ a JOIN occ b ON a.frame_no = b.frame_no AND a.side = 0 AND b.side = 1""")
PEERS = """
seen AS (SELECT *, coalesce(alias, hostname) AS name FROM occ WHERE ip IS NOT NULL AND coalesce(alias, hostname) IS NOT NULL),
peers AS (SELECT capture_id, ip, name, CASE WHEN hostname <> name THEN hostname END AS hostname, role, element_type AS network_element_type,
    source AS network_element_source, code_alias AS ss7_point_code_alias
  FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, ip ORDER BY frame_no DESC, side DESC) AS rn FROM seen) WHERE rn = 1)"""
ORACLE["resolved_peers"] = pkt(f", {ENDPOINTS}, {SIDES}, {PEERS} SELECT * FROM peers")
ORACLE["conversation_names"] = pkt(f"""
, {ENDPOINTS}, {SIDES}, {PEERS}, conv AS ({CONVERSATIONS})
SELECT conv.*, a.name AS src_name, b.name AS dst_name FROM conv
LEFT JOIN peers a ON a.capture_id = conv.capture_id AND a.ip = src LEFT JOIN peers b ON b.capture_id = conv.capture_id AND b.ip = dst""")
ORACLE["element_overview"] = pkt(f"""
, {ENDPOINTS}, {SIDES}
SELECT capture_id, 'type' AS facet, element_type AS name, count(*) AS packets FROM occ GROUP BY 1, 3
UNION ALL SELECT capture_id, 'source', source, count(*) FROM occ GROUP BY 1, 3
UNION ALL SELECT capture_id, 'warning', warning, count(*) FROM occ WHERE warning IS NOT NULL GROUP BY 1, 3""")


# ------------------------------------------------------------------ privacy
W = "[\\p{L}\\p{N}_]"
NOT_W = "[^\\p{L}\\p{N}_]"
OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = f"(^|{NOT_W})(({OCTET}\\.){{3}}{OCTET}|([0-9a-fA-F]{{1,4}}:){{2,7}}[0-9a-fA-F]{{1,4}})($|{NOT_W})"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
URI = "(https?://|sip:|tel:|www\\.)"
TOKEN = "(bearer\\s+[A-Za-z0-9._-]+|authorization|cookie|token=)"
NUMBER = f"(^|{NOT_W})[0-9]{{10,16}}($|{NOT_W})"
VALUE_CLASS = f"""CASE WHEN regexp_matches(value, '{IP}') THEN 'ip' WHEN regexp_matches(value, '{EMAIL}') THEN 'email'
  WHEN regexp_matches(value, '{TOKEN}', 'i') THEN 'token' WHEN regexp_matches(value, '{URI}', 'i') THEN 'uri'
  WHEN regexp_matches(value, '(imsi|msisdn|imei|supi|suci)', 'i') OR regexp_matches(value, '{NUMBER}') THEN 'payload_text' END"""
LEAVES = f"""
leaves AS (
  SELECT 'documents' AS capture_id, CAST(doc_id AS VARCHAR) AS leaf, text AS value, 'value' AS how FROM documents
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), url, 'value' FROM pages
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html, 'value' FROM pages
  UNION ALL SELECT 'conversations', conv_id || '-' || turn, text, CASE WHEN turn % 2 = 0 THEN 'body' ELSE 'value' END FROM conversations
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, 'host' FROM customer
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, 'realm' FROM supplier
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name, 'apn' FROM nation),
cls AS (
  SELECT *, CASE WHEN how = 'body' THEN CASE WHEN regexp_matches(value, '{IP}') THEN 'ip' ELSE 'payload_text' END
    WHEN how = 'host' THEN 'hostname' WHEN how = 'realm' THEN 'diameter_identity' WHEN how = 'apn' THEN 'apn_dnn'
    ELSE {VALUE_CLASS} END AS data_class FROM leaves)"""
ORACLE["leaf_classify"] = f"WITH {LEAVES} SELECT capture_id, leaf, data_class FROM cls"
ALIAS = "upper(data_class) || '_' || left(sha256(data_class || ':' || value), 8)"
ORACLE["protect_share"] = f"""
WITH {LEAVES} SELECT capture_id, leaf, md5(CASE WHEN data_class IN ('ip', 'hostname', 'diameter_identity') THEN {ALIAS}
  WHEN data_class IN ('email', 'uri', 'payload_text') THEN '[redacted]' ELSE value END) AS protected
FROM cls WHERE data_class IS DISTINCT FROM 'token'"""
ORACLE["protect_deep"] = f"""
WITH leaves AS (SELECT 'documents' AS capture_id, CAST(doc_id AS VARCHAR) AS leaf, text AS value FROM documents
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages),
cls AS (SELECT *, {VALUE_CLASS} AS data_class FROM leaves WHERE value IS NOT NULL)
SELECT capture_id, leaf, 20 AS depth, md5(CASE WHEN data_class = 'ip' THEN {ALIAS}
  WHEN data_class IN ('email', 'uri', 'payload_text') THEN '[redacted]' ELSE value END) AS protected
FROM cls WHERE data_class IS DISTINCT FROM 'token'"""
ORACLE["protect_lab"] = f"""
WITH {LEAVES} SELECT capture_id, data_class, count(*) AS leaves, count(*) FILTER (WHERE data_class = 'uri' OR value = '[redacted]') AS masked
FROM cls WHERE data_class IS NULL OR data_class NOT IN ('email', 'token', 'payload_text', 'diameter_identity') GROUP BY 1, 2"""
SUBSCRIBERS = """
sub AS (
  SELECT c_custkey, 'imsi' AS path, ['26201', '310410', '20801', '2620'][c_custkey % 4 + 1] || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS value FROM customer
  UNION ALL SELECT c_custkey, 'msisdn', ['+49151', '49171', '+1', '+351', '0', '+4930'][c_custkey % 6 + 1] || lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer
  UNION ALL SELECT c_custkey, 'imei', ['35', '3587', '12'][c_custkey % 3 + 1] || CASE WHEN c_custkey % 7 = 0 THEN '1' ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END FROM customer)"""


def kept(path: str, length: str, tail: str, country: str) -> str:
    return f"WHEN path = '{path}' THEN left(value, {length}) || {tail.format(n=length)} || {country}"


COUNTRY_IMSI = "CASE WHEN left(value, 3) = '262' THEN ' (Germany)' WHEN left(value, 3) = '310' THEN ' (United States of America)' ELSE '' END"
COUNTRY_TEL = "CASE WHEN c_custkey % 6 IN (0, 1, 5) THEN ' (Germany)' ELSE '' END"
TEL_LENGTH = "(CASE c_custkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 1 ELSE 3 END)"
IMSI_LENGTH = "(CASE WHEN left(value, 1) = '3' THEN 6 ELSE 5 END)"
MASKED = "repeat('X', length(value) - {n})"
ORACLE["keep_prefix"] = f"""
WITH {SUBSCRIBERS} SELECT c_custkey, path, CASE
  {kept('imsi', IMSI_LENGTH, MASKED, COUNTRY_IMSI)}
  {kept('msisdn', TEL_LENGTH, MASKED, COUNTRY_TEL)}
  WHEN length(value) <= 8 THEN '[redacted]' ELSE left(value, 8) || repeat('X', length(value) - 8) END AS protected
FROM sub"""
IMSI_LENGTH_2 = "(CASE WHEN left(value, 1) = '3' OR left(value, 3) = '208' THEN 6 ELSE 5 END)"
TEL_LENGTH_2 = "(CASE c_custkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 1 ELSE 3 END)"
HASHED = "'{up}_SUFFIX_' || left(sha256('{low}_suffix:' || left(value, {{n}}) || ':' || substr(value, {{n}} + 1)), 8)"
ORACLE["keep_prefix_pseudonym"] = f"""
WITH {SUBSCRIBERS} SELECT c_custkey, path, CASE
  {kept('imsi', IMSI_LENGTH_2, HASHED.format(up='IMSI', low='imsi'), COUNTRY_IMSI)}
  {kept('msisdn', TEL_LENGTH_2, HASHED.format(up='MSISDN', low='msisdn'), COUNTRY_TEL)}
  ELSE '[redacted]' END AS protected FROM sub"""
ORACLE["pseudonym_sha"] = f"""
WITH {LEAVES} SELECT DISTINCT data_class, value AS original, {ALIAS} AS alias FROM cls WHERE data_class IN ('diameter_identity', 'hostname', 'apn_dnn')"""
ORACLE["pseudonym_forms"] = f"""
WITH {LEAVES} SELECT DISTINCT data_class, value AS original, true AS well_formed, 1 AS aliases FROM cls WHERE data_class IN ('diameter_identity', 'hostname', 'apn_dnn')"""
ORACLE["pseudonym_audit"] = f"""
WITH {LEAVES} SELECT data_class, count(DISTINCT value) AS originals FROM cls WHERE data_class IN ('ip', 'hostname', 'diameter_identity') GROUP BY 1"""
ORACLE["pseudonym_collisions"] = f"""
WITH {SUBSCRIBERS} SELECT path AS data_class, upper(path) || '_' || left(sha256(path || ':' || value), 2) AS alias, count(DISTINCT value) AS originals
FROM sub GROUP BY 1, 2 HAVING count(DISTINCT value) > 1"""
ORACLE["encrypt_roundtrip"] = f"""
WITH {SUBSCRIBERS} SELECT c_custkey, path, CASE WHEN path = 'msisdn' THEN '[redacted]' ELSE value END AS plain, path <> 'imei' AS changed FROM sub"""
ORACLE["leak_audit"] = f"WITH {LEAVES} SELECT capture_id, data_class, count(*) AS leaves FROM cls WHERE data_class IN ('ip', 'hostname') GROUP BY 1, 2"
ORACLE["canonical_classes"] = f"""
WITH {LEAVES}, owner(data_class, canonical_class) AS (VALUES ('ip', 'network_address'), ('hostname', 'network_address'),
  ('hostname', 'operator_internal_name'), ('diameter_identity', 'operator_internal_name'), ('apn_dnn', 'operator_internal_name'),
  ('token', 'application_secret'), ('payload_text', 'payload_text'), ('email', 'payload_text'), ('uri', 'payload_text'))
SELECT canonical_class, count(*) AS leaves FROM cls JOIN owner USING (data_class) GROUP BY 1"""


# ------------------------------------------------------------------ full packets and flow
def packets(sql: str) -> str:
    return f"WITH {PACKETS}{sql}"


LEAF_ROWS = """
SELECT capture_id, 'frame' AS top, 'frame.frame.number' AS path, 2 AS depth, false AS in_list, true AS is_text, CAST(packet_no AS VARCHAR) AS value FROM pk
UNION ALL SELECT capture_id, 'frame', 'frame.frame.time_epoch', 2, false, true, (us // 1000000) || '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') FROM pk
UNION ALL SELECT capture_id, 'frame', 'frame.frame.time_relative', 2, false, true, ((us - 1704067200000000) // 1000000) || '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') FROM pk
UNION ALL SELECT capture_id, 'frame', 'frame.frame.protocols', 2, false, true, stack FROM pk
UNION ALL SELECT capture_id, 'ip', 'ip.ip.src', 2, false, true, src_ip FROM pk
UNION ALL SELECT capture_id, 'ip', 'ip.ip.dst', 2, false, true, dst_ip FROM pk
UNION ALL SELECT capture_id, proto, proto || '.' || proto || '.srcport', 2, false, true, CAST(src_port AS VARCHAR) FROM pk
UNION ALL SELECT capture_id, proto, proto || '.' || proto || '.dstport', 2, false, true, CAST(dst_port AS VARCHAR) FROM pk
UNION ALL SELECT capture_id, proto, proto || '.' || proto || CASE proto WHEN 'sctp' THEN '.assoc_index' ELSE '.stream' END, 2, false, true, CAST(user_id AS VARCHAR) FROM pk
UNION ALL SELECT capture_id, 'sctp', 'sctp.sctp.chunk_type', 2, true, true, unnest(['0', '3']) FROM pk WHERE event_type = 'signup' AND k % 5 = 0
UNION ALL SELECT capture_id, 'tcp', 'tcp.tcp.analysis.retransmission', 2, false, true, '1' FROM pk WHERE event_type = 'purchase' AND k % 11 = 0
UNION ALL SELECT capture_id, 'tcp', 'tcp.tcp.analysis.out_of_order', 2, false, true, '1' FROM pk WHERE event_type = 'purchase' AND k % 13 = 0
UNION ALL SELECT capture_id, 'diameter', 'diameter.diameter.cmd.code', 2, false, true, CASE WHEN k < 50 THEN '316' ELSE '318' END FROM pk WHERE event_type = 'view'
UNION ALL SELECT capture_id, 'diameter', 'diameter.diameter.flags', 2, false, true, CASE WHEN answer THEN '0x40' ELSE '0xc0' END FROM pk WHERE event_type = 'view'
UNION ALL SELECT capture_id, 'diameter', 'diameter.diameter.flags.request', 2, false, true, CASE WHEN answer THEN '0' ELSE '1' END FROM pk WHERE event_type = 'view' AND k <> 7
UNION ALL SELECT capture_id, 'diameter', 'diameter.diameter.hopbyhopid', 2, false, true, '0x' || ((k // 2) % 4) FROM pk WHERE event_type = 'view'
UNION ALL SELECT capture_id, 'diameter', 'diameter.diameter.Result-Code', 2, false, code <> 5004, CAST(code AS VARCHAR) FROM pk WHERE event_type = 'view' AND answer
UNION ALL SELECT capture_id, 'diameter', 'diameter.diameter.avp', 2, true, true, unnest(['aa', 'bb']) FROM pk WHERE event_type = 'view'
UNION ALL SELECT capture_id, 'diameter', 'diameter.diameter.avp_tree.diameter.Session-Id', 3, false, true, 'node;' || k FROM pk WHERE event_type = 'view'
UNION ALL SELECT capture_id, 'diameter', 'diameter.diameter.avp_tree.e212.imsi', 3, false, true, '26201' || lpad(CAST(user_id AS VARCHAR), 10, '0') FROM pk WHERE event_type = 'view'
UNION ALL SELECT capture_id, 'diameter', 'diameter._ws.expert._ws.expert.message', 3, false, true, 'note' FROM pk WHERE event_type = 'view'
UNION ALL SELECT capture_id, 'gtpv2', 'gtpv2.gtpv2.message_type', 2, false, true, CAST(32 + k % 4 AS VARCHAR) FROM pk WHERE event_type = 'click'
UNION ALL SELECT capture_id, 'gtpv2', 'gtpv2.gtpv2.seq', 2, false, true, CAST((k // 4) % 3 AS VARCHAR) FROM pk WHERE event_type = 'click'
UNION ALL SELECT capture_id, 'gtpv2', 'gtpv2.gtpv2.apn', 2, false, true, 'internet.mnc001' FROM pk WHERE event_type = 'click'
UNION ALL SELECT capture_id, 'gtpv2', 'gtpv2.Cause : .gtpv2.cause', 3, false, true, CASE k % 8 WHEN 1 THEN '16' ELSE '0x49' END FROM pk WHERE event_type = 'click' AND k % 8 IN (1, 5)
UNION ALL SELECT capture_id, 'dns', 'dns.dns.id', 2, false, true, '0x' || ((k // 2) % 5) FROM pk WHERE event_type = 'error'
UNION ALL SELECT capture_id, 'dns', 'dns.Queries.host.dns.qry.name', 4, false, true, 'Host' || (k % 4) || '.Example.org.' FROM pk WHERE event_type = 'error'
UNION ALL SELECT capture_id, 'dns', 'dns.Queries.host.dns.qry.type', 4, false, true, CASE k % 3 WHEN 1 THEN '1' WHEN 2 THEN '28' ELSE '99' END FROM pk WHERE event_type = 'error'
UNION ALL SELECT capture_id, 'dns', 'dns.dns.flags_tree.dns.flags.response', 3, false, true, CASE WHEN answer THEN '1' ELSE '0' END FROM pk WHERE event_type = 'error'
UNION ALL SELECT capture_id, 'dns', 'dns.dns.flags_tree.dns.flags.rcode', 3, false, true, CASE WHEN k % 10 = 3 THEN '3' ELSE '0' END FROM pk WHERE event_type = 'error' AND answer
UNION ALL SELECT capture_id, 'dns', 'dns.dns.count.answers', 2, false, true, CAST(k % 4 AS VARCHAR) FROM pk WHERE event_type = 'error'
UNION ALL SELECT capture_id, 'http2', 'http2.http2.headers.method', 2, false, true, 'POST' FROM pk WHERE event_type = 'purchase' AND NOT answer
UNION ALL SELECT capture_id, 'http2', 'http2.http2.headers.path', 2, false, true, '/nsmf/' || (k % 5) FROM pk WHERE event_type = 'purchase' AND NOT answer
UNION ALL SELECT capture_id, 'http2', 'http2.http2.headers.status', 2, false, true, CAST(http AS VARCHAR) FROM pk WHERE event_type = 'purchase' AND answer
UNION ALL SELECT capture_id, 'http2', 'http2.http2.streamid', 2, false, true, CAST(k % 6 AS VARCHAR) FROM pk WHERE event_type = 'purchase'
UNION ALL SELECT capture_id, 's1ap', 's1ap.s1ap.procedureCode', 2, false, true, CAST(k % 50 AS VARCHAR) FROM pk WHERE event_type = 'signup'
UNION ALL SELECT capture_id, 's1ap', 's1ap.s1ap.nas_pdu_tree.nas_eps.message_type', 3, false, true, CASE k % 4 WHEN 0 THEN '0x41' WHEN 1 THEN '0x42' WHEN 2 THEN '67' ELSE '0x99' END FROM pk WHERE event_type = 'signup'"""
ORACLE["packet_rejects"] = packets("""
, bad AS (SELECT capture_id, packet_no % 17 = 3 OR packet_no % 19 = 4 OR packet_no % 23 = 5 AS rejected FROM pk)
SELECT capture_id, count(*) FILTER (WHERE NOT rejected) AS kept, count(*) FILTER (WHERE rejected) AS rejected FROM bad GROUP BY 1""")
ORACLE["packet_pseudonyms"] = packets(f"""
, leaves AS ({LEAF_ROWS}),
seen(data_class, original, prefix) AS (
  SELECT DISTINCT 'ip', ip, 'IP_' FROM (SELECT src_ip AS ip FROM pk UNION SELECT dst_ip FROM pk)
  UNION SELECT 'ip', 'node-' || ip, 'IP_' FROM (SELECT src_ip AS ip FROM pk UNION SELECT dst_ip FROM pk)
  UNION SELECT 'hostname', value, 'HOSTNAME_' FROM leaves WHERE top = 'dns'
  UNION SELECT 'apn_dnn', value, 'APN_DNN_' FROM leaves WHERE path = 'gtpv2.gtpv2.apn'
  UNION SELECT 'imsi_suffix', '26201:' || substr(value, 6), 'IMSI_SUFFIX_' FROM leaves WHERE path LIKE '%e212.imsi')
SELECT data_class, original, prefix || left(sha256(data_class || ':' || original), 8) AS alias FROM seen""")
ORACLE["packet_leaks"] = packets("""
SELECT capture_id, 'ip' AS data_class, 6 * count(*) AS leaves FROM pk GROUP BY 1
UNION ALL SELECT capture_id, 'imsi', count(*) FROM pk WHERE event_type = 'view' GROUP BY 1
UNION ALL SELECT capture_id, 'hostname', 5 * count(*) + count(*) FILTER (WHERE answer) FROM pk WHERE event_type = 'error' GROUP BY 1""")
ORACLE["packet_leaves"] = packets(f"""
, leaves AS ({LEAF_ROWS})
SELECT capture_id, top, path, depth, in_list, is_text, count(*) AS leaves, min(value) AS smallest, count(DISTINCT value) AS values
FROM leaves GROUP BY ALL""")
ORACLE["normalised_packets"] = packets("""
SELECT capture_id, packet_no, round((us - 1704067200000000) / 1000000.0::DOUBLE, 6) AS time_rel_ms,
  (us // 1000000) || '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') AS time_epoch, top_protocol, stack, src_ip, dst_ip, proto, src_port, dst_port,
  CAST(user_id AS VARCHAR) AS stream, event_type = 'purchase' AND notes <> '' AS anomaly, notes, true AS is_valid FROM pk""")
ORACLE["message_fields"] = packets(f"""
, leaves AS ({LEAF_ROWS}),
kept AS (SELECT capture_id, substr(path, length(top) + 2) AS path, CASE WHEN in_list THEN '["aa","bb"]' ELSE value END AS value FROM leaves
  WHERE top IN ('diameter', 'gtpv2', 'dns', 'http2', 's1ap') AND path NOT LIKE '%.\\_ws.%' ESCAPE '\\' AND value <> 'bb')
SELECT capture_id, path, count(*) AS n, min(value) AS lo, max(value) AS hi FROM kept GROUP BY 1, 2""")
ORACLE["verbatim_fields"] = packets(f"""
, leaves AS ({LEAF_ROWS}),
kept AS (SELECT capture_id, CASE WHEN path LIKE '%Session-Id' THEN 'diameter.Session-Id' ELSE substr(path, 10) END AS path, value FROM leaves
  WHERE top = 'diameter' AND path NOT LIKE '%.\\_ws.%' ESCAPE '\\' AND NOT in_list AND path NOT LIKE '%e212.imsi')
SELECT capture_id, path, count(*) AS n, min(value) AS lo, max(value) AS hi FROM kept GROUP BY 1, 2""")
ORACLE["deep_fields"] = packets("""
SELECT capture_id, packet_no, CASE event_type WHEN 'click' THEN CASE k % 8 WHEN 1 THEN '16' WHEN 5 THEN '0x49' END
    WHEN 'error' THEN CASE WHEN answer THEN CASE WHEN k % 10 = 3 THEN '3' ELSE '0' END END
    WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN '0x41' WHEN 1 THEN '0x42' WHEN 2 THEN '67' ELSE '0x99' END END AS found,
  CASE WHEN event_type = 'view' THEN '["aa","bb"]' END AS avp FROM pk""")
ORACLE["message_labels"] = packets("SELECT capture_id, packet_no, message_name, status, correlation_id, src_node, dst_node FROM flow")
ORACLE["flow_events"] = packets(f""", {EVENTS}
SELECT capture_id, event_no, first_packet_no, last_packet_no, src_node, dst_node, message_name, status, correlation_id,
  'pkt ' || first_packet_no || CASE WHEN repeat_count > 1 THEN '..' || last_packet_no ELSE '' END AS detail_label, repeat_count,
  round(last_relative_ms, 6) AS last_relative_ms FROM ev""")
CAPPED = EVENTS.replace("FROM flow WINDOW", "FROM (SELECT * FROM flow QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY packet_no) <= 120) WINDOW")
ORACLE["flow_capped"] = packets(f", {CAPPED} SELECT capture_id, event_no, first_packet_no, message_name, repeat_count FROM ev")
ORACLE["event_refs"] = packets(f", {EVENTS} SELECT capture_id, event_no, packet_no FROM numbered")


def fifo_sql(source: str, keys: str, order: str, asks: str, tag: str) -> str:
    """CTEs ending in ``pairs_{tag}``: the reflected walk with plain windows."""
    return f"""
s_{tag} AS (SELECT *, sum(CASE WHEN {asks} THEN 1 ELSE -1 END) OVER (PARTITION BY {keys} ORDER BY {order}) AS level FROM {source}),
m_{tag} AS (SELECT *, NOT {asks} AND level >= least(0, coalesce(min(level) OVER (PARTITION BY {keys} ORDER BY {order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS matched FROM s_{tag}),
c_{tag} AS (SELECT *, sum(CASE WHEN {asks} THEN 1 ELSE 0 END) OVER w AS nq, sum(CASE WHEN matched THEN 1 ELSE 0 END) OVER w AS np
    FROM m_{tag} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
pairs_{tag} AS (SELECT q.*, p.{order} AS response FROM c_{tag} q JOIN c_{tag} p USING ({keys}) WHERE q.{asks} AND p.matched AND q.nq = p.np)"""


ORACLE["fifo_pairs"] = pkt(f"""
, f AS (SELECT capture_id, user_id, frame_no, event_type IN ('view', 'signup') AS asks FROM base WHERE event_type IN ('view', 'signup', 'click', 'purchase')),
{fifo_sql('f', 'capture_id, user_id', 'frame_no', 'asks', 'a')}
SELECT capture_id, user_id, frame_no AS request, response FROM pairs_a""")
PAIRS = f"""
, pe AS (SELECT capture_id, frame_no AS event_no, event_type AS protocol, CASE WHEN k % 10 >= 3 THEN 'id:' || (k // 20) END AS corr,
    ['alpha', 'beta', 'gamma'][user_id % 3 + 1] AS stem, k % 2 = 0 AS asks, 'a' || (user_id % 2) || '|b' || (k % 3) AS route,
    CASE WHEN k % 2 = 0 THEN 'request' WHEN k % 7 = 0 THEN 'error' ELSE 'response' END AS status FROM base),
keyed AS (SELECT *, protocol || '|' || coalesce(corr, stem) || '|' || route AS strict_key, protocol || '|' || stem || '|' || route AS loose_key FROM pe),
{fifo_sql('keyed', 'capture_id, strict_key', 'event_no', 'asks', 'a')},
done AS (SELECT capture_id, event_no FROM pairs_a UNION SELECT capture_id, response FROM pairs_a),
rest AS (SELECT * FROM keyed ANTI JOIN done USING (capture_id, event_no) WHERE asks OR corr IS NOT NULL),
{fifo_sql('rest', 'capture_id, loose_key', 'event_no', 'asks', 'b')},
pairs AS (SELECT capture_id, event_no AS request, response, 'strict' AS by FROM pairs_a UNION ALL SELECT capture_id, event_no, response, 'loose' FROM pairs_b)"""
ORACLE["paired_events"] = pkt(f"{PAIRS} SELECT * FROM pairs")
ORACLE["pair_write_back"] = pkt(f"""{PAIRS}
SELECT pe.capture_id, pe.event_no, status, asks AS is_request, NOT asks AS is_response, 'event-' || coalesce(r.response, a.request) AS paired_event_id
FROM pe LEFT JOIN pairs r ON r.capture_id = pe.capture_id AND r.request = pe.event_no LEFT JOIN pairs a ON a.capture_id = pe.capture_id AND a.response = pe.event_no""")
IN_ORDER = f"""
{PAIRS[:PAIRS.index("s_a AS")].rstrip()}
ided AS (SELECT * FROM keyed WHERE corr IS NOT NULL),
{fifo_sql('ided', 'capture_id, strict_key', 'event_no', 'asks', 'a')},
rest AS (SELECT * FROM keyed ANTI JOIN (SELECT capture_id, response AS event_no FROM pairs_a) USING (capture_id, event_no)),
{fifo_sql('rest', 'capture_id, loose_key', 'event_no', 'asks', 'b')},
pairs AS (SELECT capture_id, event_no AS request, response, 'strict' AS by FROM pairs_a UNION ALL SELECT capture_id, event_no, response, 'loose' FROM pairs_b)"""
ORACLE["paired_in_order"] = pkt(f"{IN_ORDER} SELECT * FROM pairs")
ORACLE["pair_write_back_in_order"] = pkt(f"""{IN_ORDER},
asked AS (SELECT capture_id, request, max(response) AS response FROM pairs GROUP BY 1, 2)
SELECT pe.capture_id, pe.event_no, status, asks AS is_request, NOT asks AS is_response, 'event-' || coalesce(r.response, a.request) AS paired_event_id
FROM pe LEFT JOIN asked r ON r.capture_id = pe.capture_id AND r.request = pe.event_no LEFT JOIN pairs a ON a.capture_id = pe.capture_id AND a.response = pe.event_no""")
KIND = """CASE
  WHEN regexp_matches(lower(message_name), 'attach|initial ue|downlink nas transport') THEN 'registration|Registration'
  WHEN regexp_matches(lower(message_name), 'create session|modify bearer|gtpv2') THEN 'session_setup|Session Setup'
  WHEN regexp_matches(lower(message_name), 'reject|fail|error|timeout|401|403|500') THEN 'failure|Failure / Retry'
  WHEN regexp_matches(lower(message_name), 'auth|air|aia|aka|eap') THEN 'authentication|Authentication'
  WHEN regexp_matches(lower(message_name), 'security|smc') THEN 'security|Security Mode'
  WHEN regexp_matches(lower(message_name), 'session|createsmcontext|pfcp') THEN 'session_setup|Session Setup'
  WHEN regexp_matches(lower(message_name), 'register') THEN 'registration|Registration'
  WHEN regexp_matches(lower(message_name), 'release|detach') THEN 'release|Release'
  WHEN status = 'error' THEN 'failure|Failure / Retry' ELSE 'signaling|Signaling' END"""
ORACLE["flow_phases"] = packets(f""", {EVENTS},
ph AS (SELECT capture_id, event_no, {KIND} AS kl FROM ev),
pm AS (SELECT *, CASE WHEN lag(kl) OVER (PARTITION BY capture_id ORDER BY event_no) = kl THEN 0 ELSE 1 END AS st FROM ph),
pn AS (SELECT *, sum(st) OVER (PARTITION BY capture_id ORDER BY event_no) AS phase_no FROM pm)
SELECT capture_id, phase_no, 'phase-' || phase_no AS id, split_part(min(kl), '|', 2) AS label, split_part(min(kl), '|', 1) AS kind,
  'event-' || min(event_no) AS start_event, 'event-' || max(event_no) AS end_event FROM pn GROUP BY 1, 2""")
ORACLE["batch_overview"] = packets(f""", {EVENTS},
fev AS (SELECT capture_id, event_no, arg_min(src_node, packet_no) AS s, arg_min(dst_node, packet_no) AS d, lower(arg_min(message_name, packet_no)) AS name,
    arg_min(status, packet_no) AS status, arg_min(correlation_id, packet_no) AS corr, arg_min(top_protocol, packet_no) AS protocol, count(*) AS packets FROM numbered GROUP BY 1, 2),
stems AS (SELECT *, status = 'response' OR regexp_matches(name, ' response| answer| ack| complete|accept|success| aia') AS answers,
    CASE WHEN regexp_matches(name, '( response| answer| resp| request| req)$') THEN trim(regexp_replace(name, '( response| answer| resp| request| req)$', '')) ELSE name END AS stem FROM fev),
routed AS (SELECT *, NOT answers AS asks, CASE WHEN answers THEN d || '|' || s ELSE s || '|' || d END AS route FROM stems),
keyed AS (SELECT *, protocol || '|' || coalesce(corr, stem) || '|' || route AS strict_key, protocol || '|' || stem || '|' || route AS loose_key FROM routed),
{fifo_sql('keyed', 'capture_id, strict_key', 'event_no', 'asks', 'a')},
done AS (SELECT capture_id, event_no FROM pairs_a UNION SELECT capture_id, response FROM pairs_a),
rest AS (SELECT * FROM keyed ANTI JOIN done USING (capture_id, event_no) WHERE asks OR corr IS NOT NULL),
{fifo_sql('rest', 'capture_id, loose_key', 'event_no', 'asks', 'b')},
linked AS (SELECT capture_id, 2 * count(*) AS paired FROM (SELECT capture_id FROM pairs_a UNION ALL SELECT capture_id FROM pairs_b) GROUP BY 1),
lanes AS (SELECT capture_id, count(*) AS nodes FROM (SELECT capture_id, src_node FROM flow UNION SELECT capture_id, dst_node FROM flow) GROUP BY 1),
ph AS (SELECT capture_id, event_no, {KIND} AS kl FROM ev),
pm AS (SELECT capture_id, CASE WHEN lag(kl) OVER (PARTITION BY capture_id ORDER BY event_no) = kl THEN 0 ELSE 1 END AS st FROM ph),
steps AS (SELECT capture_id, sum(st) AS phases FROM pm GROUP BY 1)
SELECT capture_id, count(*) AS events, CAST(sum(packets) AS BIGINT) AS packets, count(*) FILTER (WHERE status = 'error') AS errors, min(coalesce(paired, 0)) AS paired,
  min(nodes) AS nodes, CAST(min(phases) AS BIGINT) AS phases FROM fev JOIN lanes USING (capture_id) JOIN steps USING (capture_id) LEFT JOIN linked USING (capture_id) GROUP BY 1""")
ORACLE["flow_nodes"] = packets("""
, n AS (SELECT DISTINCT capture_id, src_node AS id, src_ip AS ip FROM flow UNION SELECT DISTINCT capture_id, dst_node, dst_ip FROM flow),
a AS (SELECT capture_id, id, CASE WHEN id = 'alias:core-1' THEN 'core-1 (' || ip || ')' ELSE ip END AS label,
    CASE WHEN ip LIKE '192.%' THEN 'mme' ELSE 'enb' END AS role, 'endpoint' AS family, id = 'alias:core-1' AS pseudonymized,
    CASE WHEN ip LIKE '192.%' THEN 30 ELSE 20 END AS lane_priority FROM n)
SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY lane_priority, label, id) - 1 AS lane_index FROM a""")
ORACLE["flow_totals"] = packets(f""", {CAPPED}
SELECT capture_id, packet_count_total, event_count_uncollapsed, event_count_rendered, time_span_ms, first_packet_date,
  CASE WHEN packet_count_total > 120 THEN 'Flow visualization truncated to 120 events out of ' || packet_count_total || '.' END AS warning
FROM (SELECT capture_id, count(*) AS packet_count_total, strftime(make_timestamp(arg_min(us, packet_no)), '%d.%m.%Y') AS first_packet_date FROM flow GROUP BY 1)
JOIN (SELECT capture_id, count(*) AS event_count_uncollapsed FROM numbered GROUP BY 1) USING (capture_id)
JOIN (SELECT capture_id, count(*) AS event_count_rendered, round(max(rel) - min(rel), 3) AS time_span_ms FROM ev GROUP BY 1) USING (capture_id)""")
ORACLE["collapse_turns"] = """
WITH t AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'a' ELSE 'b' END AS message_name FROM conversations),
m AS (SELECT *, CASE WHEN lag(role || message_name) OVER (PARTITION BY conv_id ORDER BY turn) = role || message_name THEN 0 ELSE 1 END AS st FROM t),
n AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS event_no FROM m)
SELECT conv_id, event_no, min(role) AS src_node, min(message_name) AS message_name, min(turn) AS first_packet_no, max(turn) AS last_packet_no, count(*) AS repeat_count
FROM n GROUP BY 1, 2"""


def access(sql: str) -> str:
    return f"WITH {ACCESS}{sql}"


ORACLE["access_packets"] = access("""
SELECT capture_id, packet_no, top_protocol, src_ip, dst_ip, CASE WHEN event_type = 'click' THEN CAST(k % 16 AS VARCHAR) END AS src_point_code,
  CASE WHEN event_type = 'click' AND k % 3 > 0 THEN '9' END AS dst_point_code,
  CASE event_type WHEN 'error' THEN 'udp' WHEN 'purchase' THEN 'tcp' ELSE 'sctp' END AS proto,
  CASE event_type WHEN 'error' THEN 5060 WHEN 'purchase' THEN NULL ELSE 38412 END AS src_port, true AS is_valid FROM ac""")
ORACLE["access_fields"] = access("""
, f(capture_id, path, value) AS (
  SELECT capture_id, 'ngap.x', '["a","b"]' FROM ac WHERE event_type = 'view' UNION ALL SELECT capture_id, 'ngap.procedureCode', code FROM ac WHERE event_type = 'view'
  UNION ALL SELECT capture_id, 'nas_5gs.tree.nas_5gs.mm.message_type', code FROM ac WHERE event_type = 'signup'
  UNION ALL SELECT capture_id, unnest(['sctp.srcport', 'sctp.dstport']), '38412' FROM ac WHERE event_type = 'click'
  UNION ALL SELECT capture_id, 'message_name', code FROM ac WHERE event_type = 'error'
  UNION ALL SELECT capture_id, 'tcp.stream', CAST(user_id AS VARCHAR) FROM ac WHERE event_type = 'purchase')
SELECT capture_id, path, value, count(*) AS n FROM f GROUP BY ALL""")
ORACLE["whitelist_fields"] = access("""
SELECT capture_id, packet_no, 'ipv6.src' AS path, src_ip AS value FROM ac WHERE event_type = 'view'
UNION ALL SELECT capture_id, packet_no, 'sctp.srcport', '38412' FROM ac WHERE event_type = 'view'
UNION ALL SELECT capture_id, packet_no, 'udp.dstport', '5060' FROM ac WHERE event_type = 'error'
UNION ALL SELECT capture_id, packet_no, 'frame.number', CAST(packet_no AS VARCHAR) FROM ac WHERE event_type = 'error'""")
ORACLE["listed_fields"] = pkt("""
, kept AS (
  SELECT *, 'view' AS kind, 'map' AS top_protocol, 'gsm_map.opcode' AS path, CAST(k % 7 AS VARCHAR) AS value FROM base
  UNION ALL SELECT *, 'view', 'map', 'e212.imsi', '26201' || user_id FROM base
  UNION ALL SELECT *, 'signup', 'isup', 'isup.cic', CAST(k AS VARCHAR) FROM base
  UNION ALL SELECT *, 'signup', 'isup', 'e164.called_party_number.digits', '49' || user_id FROM base
  UNION ALL SELECT *, 'click', 'dns', 'dns.id', CAST(k AS VARCHAR) FROM base
  UNION ALL SELECT *, 'click', 'dns', 'dns.a', '["1","2"]' FROM base
  UNION ALL SELECT *, 'click', 'dns', 'dns.flags', CAST(k % 3 AS VARCHAR) FROM base
  UNION ALL SELECT *, 'error', 'gsm_a.dtap', 'gsm_a.imsi', CAST(user_id AS VARCHAR) FROM base
  UNION ALL SELECT *, 'error', 'gsm_a.dtap', 'gsm_a.dtap.code', CAST(k % 5 AS VARCHAR) FROM base)
SELECT capture_id, frame_no AS packet_no, top_protocol, path, value FROM kept WHERE event_type = kind""")
ORACLE["reduced_transport"] = access("""
, kept(profile, kept) AS (VALUES ('lte-s6a', 'proto,src_port,dst_port,stream,sctp_stream,anomaly,notes'), ('volte-sip', 'proto,src_port,dst_port,stream,anomaly,notes'),
  ('2g3g-gn', 'proto,src_port,dst_port,stream,anomaly,notes'))
SELECT capture_id, profile, kept, count(*) AS packets FROM ac, kept GROUP BY ALL""")
ORACLE["access_labels"] = access("""
SELECT capture_id, packet_no, message_name, CASE WHEN message_name = 'Registration Reject' THEN 'error' ELSE 'request' END AS status FROM ac""")
ORACLE["access_phases"] = access("""
, marks AS (SELECT *, CASE WHEN lag(src_ip || '|' || dst_ip || '|' || message_name || '|' || top_protocol) OVER w = src_ip || '|' || dst_ip || '|' || message_name || '|' || top_protocol
    THEN 0 ELSE 1 END AS starts FROM ac WINDOW w AS (PARTITION BY capture_id ORDER BY packet_no)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY capture_id ORDER BY packet_no) AS event_no FROM marks),
ev AS (SELECT DISTINCT capture_id, event_no, message_name FROM numbered),
ph AS (SELECT capture_id, event_no, '5g-n2' AS profile, CASE WHEN message_name LIKE 'Registration%' OR message_name = 'REGISTER' THEN 'registration|Registration'
    ELSE 'signaling|Signaling' END AS kl FROM ev
  UNION ALL SELECT capture_id, event_no, 'vonr-ims-core', CASE message_name WHEN 'REGISTER' THEN 'authentication|Authentication' WHEN 'INVITE sip' THEN 'signaling|Call Signaling'
    WHEN '180 Ringing' THEN 'signaling|Call Signaling' WHEN 'Registration Reject' THEN 'failure|Failure / Retry' ELSE 'signaling|Signaling' END FROM ev),
pm AS (SELECT *, CASE WHEN lag(split_part(kl, '|', 1)) OVER (PARTITION BY capture_id, profile ORDER BY event_no) = split_part(kl, '|', 1) THEN 0 ELSE 1 END AS st FROM ph),
pn AS (SELECT *, sum(st) OVER (PARTITION BY capture_id, profile ORDER BY event_no) AS phase_no FROM pm)
SELECT capture_id, profile, phase_no, 'phase-' || phase_no AS id, split_part(arg_min(kl, event_no), '|', 2) AS label, split_part(min(kl), '|', 1) AS kind,
  'event-' || min(event_no) AS start_event, 'event-' || max(event_no) AS end_event FROM pn GROUP BY 1, 2, 3""")
ORACLE["hostname_resolve"] = pkt("""
SELECT DISTINCT 'MME-' || k AS hostname, CASE WHEN k < 25 AND k % 5 = 0 THEN 'mme-' || k END AS alias, CAST(NULL AS VARCHAR) AS role, 'MME' AS element_type,
  'hostname_pattern' AS source FROM pkt WHERE event_type = 'error'""")
ORACLE["detection_gate"] = pkt("""
, s AS (SELECT src_ip AS ip, CAST(NULL AS INTEGER) AS port FROM pkt UNION SELECT dst_ip, CASE WHEN frame_no % 2 = 0 THEN dst_port END FROM pkt)
SELECT port, CASE port WHEN 53 THEN 'DNS' WHEN 3868 THEN 'DRA' WHEN 2123 THEN 'SGW' WHEN 36412 THEN 'MME' WHEN 443 THEN 'unknown' END AS element_type,
  CASE WHEN port = 443 THEN 'unknown' WHEN port IS NOT NULL THEN 'protocol' END AS source, count(DISTINCT ip) AS addresses FROM s GROUP BY 1, 2, 3""")


# ------------------------------------------------------------------ evidence, domains, ranking
MIX_LIST = (
    "['diameter', 's1ap', 'nas-eps', 'gtpv2', 'dns', 'ngap', 'nas-5gs', 'http2', 'json', 'sip', 'sdp', 'map', 'tcap', 'sccp',"
    " 'bssap', 'dtap', 'gtp', 'udp', 'data', 'gsm_map', 'isup', 'gtpv1', 'mtp3', 'ss7', 'cap', 'rtp', 'gsm_a', 'pfcp', 'bssmap', 'sbcap', 'rtcp', 'icmp']"
)
MIX_NAMES = "['mme', 'pcscf-ims', 'smf', 'host', 'sbc', 's10-inter-mme', 'amf-n26', 'registrar', 'sgw', 'pgw-s5', 'udm-ausf', 'hss']"
LINKS = "'eth', 'ip', 'tcp', 'udp', 'sctp', 'data'"
MIX = f"""
base AS (SELECT user_id % 120 AS c, 1 + (user_id % 120) // 40 AS step, event_id + 1 AS frame_no, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS place FROM events),
mix AS (SELECT 'm' || c AS capture_id,
    CASE WHEN c % 4 = 3 AND place > 1 THEN 'tcp' ELSE {MIX_LIST}[(c * 3 + step * CASE WHEN c % 5 = 0 THEN place ELSE place // 2 END) % 32 + 1] END AS top,
    ['sctp', 'udp', 'tcp'][(c + place) % 3 + 1] AS transport, {MIX_LIST}[(c * 3 + step * place) % 32 + 1] AS inner_protocol,
    CASE WHEN k % 9 = 0 THEN {MIX_NAMES}[c % 12 + 1] || '-' || k
      || CASE WHEN c % 2 = 0 THEN '.epc.mnc001.mcc262.3gppnetwork.org' ELSE '.example' END END AS name,
    CASE WHEN k % 9 = 0 AND c % 3 = 0 THEN ['mme', 'hss', 'sgw', 'pgw', 'Other'][(k // 9) % 5 + 1] END AS role FROM base),
totals AS (SELECT capture_id, count(*) AS total FROM mix GROUP BY 1),
pc AS (SELECT capture_id, top AS name, count(*) AS n FROM mix GROUP BY 1, 2),
tc AS (SELECT capture_id, transport AS name, count(*) AS n FROM mix GROUP BY 1, 2),
names AS (SELECT capture_id, name FROM pc UNION SELECT capture_id, name FROM tc UNION SELECT capture_id, inner_protocol FROM mix
  UNION SELECT capture_id, 'eth' FROM mix UNION SELECT capture_id, 'ip' FROM mix),
own AS (SELECT names.capture_id, names.name, coalesce(pc.n, CASE WHEN names.name IN ({LINKS}) THEN tc.n END, 0) AS n FROM names
  LEFT JOIN pc ON pc.capture_id = names.capture_id AND pc.name = names.name LEFT JOIN tc ON tc.capture_id = names.capture_id AND tc.name = names.name)"""


def evidence_sql(owners: str, tag: str) -> str:
    return f"""
{tag}_spread AS (SELECT capture_id, unnest({owners}) AS protocol, n FROM own),
{tag} AS (SELECT capture_id, protocol, packets, CASE WHEN packets = 0 THEN CASE WHEN protocol IN ({LINKS}) THEN 0.35 ELSE 0.85 END
    WHEN packets / total < 0.005 THEN 0.2 WHEN packets / total < 0.01 THEN 0.4 WHEN packets / total < 0.05 THEN 0.7 ELSE 1.0 END::DOUBLE AS factor,
    CASE WHEN packets > 0 THEN 'count' ELSE 'raw' END AS source
  FROM (SELECT capture_id, protocol, CAST(sum(n) AS BIGINT) AS packets FROM {tag}_spread GROUP BY 1, 2) JOIN totals USING (capture_id))"""


RANK_EV = evidence_sql("CASE name WHEN 'http2' THEN ['http2', 'http'] WHEN 'gsm_map' THEN ['gsm_map', 'map'] WHEN 'bssap' THEN ['bssap', 'bssap+'] ELSE [name] END", "ev")
SIG_EV = evidence_sql("CASE name WHEN 'http2' THEN ['http'] WHEN 'gsm_map' THEN ['map'] ELSE [name] END", "sig")
ORACLE["ranking_evidence"] = f"WITH {MIX}, {RANK_EV} SELECT * FROM ev"
ORACLE["signalling_evidence"] = f"WITH {MIX}, {SIG_EV} SELECT * FROM sig"
DOMAINS = f"""
combos(ord, need, domain, base) AS (VALUES {oracle_rank.combo_values()}),
present AS (SELECT capture_id, list(protocol) AS present FROM ev GROUP BY 1),
tried AS (SELECT p.capture_id, c.ord, c.domain, c.base, unnest(c.need) AS protocol FROM present p JOIN combos c
    ON len(list_filter(c.need, lambda x: NOT list_contains(p.present, x))) = 0
  UNION ALL SELECT capture_id, 99, 'legacy-2g3g-gprs', 0.65::DOUBLE, 'gtp' FROM present
    WHERE list_contains(present, 'gtp') AND list_contains(present, 'udp') AND NOT list_contains(present, 'gtpv2') AND NOT list_contains(present, 'gtpv1')),
rated AS (SELECT t.capture_id, t.ord, t.domain, min(t.base) * min(CASE WHEN t.protocol NOT IN ({LINKS}) THEN e.factor END) AS score
  FROM tried t JOIN ev e USING (capture_id, protocol) GROUP BY 1, 2, 3),
best AS (SELECT capture_id, domain, max(score) AS score, min(ord) AS first_ord FROM rated GROUP BY 1, 2),
kept AS (SELECT *, count(*) FILTER (WHERE domain <> 'dns-support') OVER (PARTITION BY capture_id) AS others FROM best),
found AS (SELECT capture_id, domain, round(score, 2) AS score, first_ord, count(*) OVER (PARTITION BY capture_id) AS n FROM kept
  WHERE score >= 0.35 AND NOT (domain = 'dns-support' AND others > 0)),
domains AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, first_ord) AS rank, domain, score,
    CASE WHEN n = 1 OR score >= 0.7 THEN 'primary' WHEN score >= 0.4 THEN 'secondary' ELSE 'supporting' END AS role FROM found)"""
ORACLE["domain_infer"] = f"WITH {MIX}, {RANK_EV}, {DOMAINS} SELECT * FROM domains"
SIGNALS = """
roles AS (SELECT s.*, CASE WHEN protocol IN ('ngap', 'nas-5gs', 'nr-rrc', 'http', 'json', 'pfcp', 's1ap', 'nas-eps', 'diameter', 'gtpv2', 'gtpv1', 'sip', 'sdp', 'rtp',
      'rtcp', 'dns', 'map', 'tcap', 'sccp', 'mtp3', 'm3ua', 'bssap', 'bssmap', 'dtap', 'isup', 'cap', 'sbcap') THEN 1
    WHEN protocol IN ('sctp', 'tcp', 'udp') THEN 2 ELSE 3 END AS role,
  coalesce(map {'ngap': 120, 'nas-5gs': 115, 'http': 105, 'json': 100, 'pfcp': 98, 's1ap': 96, 'sip': 94, 'sdp': 92, 'dns': 90, 'nas-eps': 88, 'diameter': 86,
    'gtpv2': 84, 'gtpv1': 78, 'map': 76, 'tcap': 74, 'sccp': 72, 'mtp3': 70, 'bssap': 68, 'dtap': 64, 'isup': 60}[protocol], 0) AS priority, d.domain AS primary_domain
  FROM sig s LEFT JOIN domains d ON d.capture_id = s.capture_id AND d.rank = 1),
usable AS (SELECT * FROM roles WHERE role = 2 OR (role = 1 AND (source = 'count' OR primary_domain IS NULL OR primary_domain = 'dns-support'
  OR (primary_domain = '5g-sa-core' AND protocol IN ('ngap', 'nas-5gs', 'http', 'json', 'pfcp', 'dns'))
  OR (primary_domain = '5g-sa-core-sbi' AND protocol IN ('http', 'json', 'pfcp', 'dns'))
  OR (primary_domain = 'lte-eps' AND protocol IN ('s1ap', 'nas-eps', 'diameter', 'gtpv2', 'dns'))
  OR (primary_domain = 'ims-voice' AND protocol IN ('sip', 'sdp', 'dns', 'rtp', 'rtcp'))
  OR (primary_domain = 'legacy-2g3g' AND protocol IN ('map', 'tcap', 'sccp', 'mtp3', 'bssap', 'dtap', 'isup', 'cap'))
  OR (primary_domain = 'legacy-2g3g-gprs' AND protocol IN ('gtpv1', 'dns')))))"""
BY = "CASE WHEN source = 'count' THEN 0 ELSE 1 END, packets DESC, factor DESC, priority DESC, protocol"
ORACLE["dominant_signalling"] = f"""
WITH {MIX}, {RANK_EV}, {SIG_EV}, {DOMAINS}, {SIGNALS},
s AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {BY}) AS place, count(*) FILTER (WHERE factor >= 0.5) OVER (PARTITION BY capture_id) AS strong
  FROM usable WHERE role = 1),
chosen AS (SELECT capture_id, protocol, CASE WHEN source = 'count' THEN 'strong' ELSE 'supporting' END AS strength, packets, place FROM s
  WHERE CASE WHEN strong > 0 THEN factor >= 0.5 ELSE place <= 5 END),
both_kinds AS (SELECT * FROM chosen UNION ALL SELECT capture_id, protocol, 'supporting', packets, 1000 FROM usable
  WHERE protocol = 'sctp' AND capture_id IN (SELECT capture_id FROM chosen))
SELECT * FROM (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY place) AS rank, protocol, strength, nullif(packets, 0) AS packets FROM both_kinds) WHERE rank <= 10"""
ORACLE["relevant_signalling"] = f"""
WITH {MIX}, {RANK_EV}, {SIG_EV}, {DOMAINS}, {SIGNALS}
SELECT * FROM (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY role, {BY}) AS rank, protocol FROM usable) WHERE rank <= 12"""
ORACLE["capture_context"] = f"""
WITH {MIX}, {SIG_EV}
SELECT capture_id, coalesce(string_agg(protocol, ',' ORDER BY protocol) FILTER (WHERE protocol IN ('eth', 'ip', 'data', 'gtp', 'gsm_a', 'ss7', 'icmp')), '') AS link_or_envelope_protocols,
  coalesce(string_agg(protocol, ',' ORDER BY protocol) FILTER (WHERE protocol IN ('sctp', 'tcp', 'udp')), '') AS transport_support_protocols FROM sig GROUP BY 1"""
ORACLE["profile_base_scores"] = f"""
WITH {MIX}, {RANK_EV}, {oracle_rank.PROFILES.strip()},
uses AS (
  SELECT profile, protocol, 5.0::DOUBLE AS weight FROM (SELECT profile, unnest(strong) AS protocol FROM prof)
  UNION ALL SELECT profile, protocol, 2.0 FROM (SELECT profile, strong, unnest(triggers) AS protocol FROM prof) WHERE NOT list_contains(strong, protocol)
  UNION ALL SELECT profile, protocol, 0.5 FROM (SELECT profile, strong, triggers, unnest(weak) AS protocol FROM prof)
    WHERE NOT list_contains(strong, protocol) AND NOT list_contains(triggers, protocol)),
signal AS (SELECT e.capture_id, u.profile, sum(u.weight * e.factor) AS score FROM uses u JOIN ev e USING (protocol)
  WHERE protocol NOT IN ('ip', 'ipv6', 'tcp', 'udp', 'sctp') AND u.profile <> 'core-name-resolution' GROUP BY 1, 2),
carried AS (SELECT e.capture_id, p.profile, sum(CASE e.protocol WHEN 'sctp' THEN 0.5 ELSE 0.2 END::DOUBLE) AS bonus FROM prof p JOIN ev e
  ON e.protocol IN ('sctp', 'tcp', 'udp') AND list_contains(p.relevant, e.protocol) GROUP BY 1, 2)
SELECT s.capture_id, s.profile, round(s.score + coalesce(c.bonus, 0), 4) AS base FROM signal s LEFT JOIN carried c USING (capture_id, profile)"""
SHAPE = f"""
tot AS (SELECT capture_id, CAST(sum(n) AS BIGINT) AS counted, CAST(coalesce(sum(n) FILTER (WHERE name NOT IN ({LINKS})), 0) AS BIGINT) AS signalling FROM pc GROUP BY 1),
raws AS (SELECT capture_id, list(protocol ORDER BY protocol) AS signals FROM roles WHERE role = 1 GROUP BY 1),
dom AS (SELECT capture_id, count(*) FILTER (WHERE score >= 0.6) AS high, count(*) FILTER (WHERE score < 0.6) AS medium,
    list(domain ORDER BY rank) FILTER (WHERE score >= 0.6) AS hs, list(domain ORDER BY rank) FILTER (WHERE score < 0.6) AS ms FROM domains GROUP BY 1),
shape AS (SELECT capture_id, counted, signalling, CASE
    WHEN signalling / counted < 0.05 AND signals IS NULL THEN 'transport_only|less than 5% signaling protocol traffic detected'
    WHEN signalling / counted < 0.05 THEN CASE WHEN high IS NULL THEN 'unknown|' ELSE 'single_domain|' END
      || 'decoded top protocols are coarse, but raw signaling hints are present: ' || array_to_string(signals[1:4], ', ')
    WHEN high IS NULL THEN 'unknown|no domain signal strong enough to classify'
    WHEN high = 1 AND medium = 0 THEN 'single_domain|strong ' || hs[1] || ' signal, no competing domain'
    WHEN high >= 2 THEN 'mixed_domain|co-dominant domains: ' || array_to_string(hs[1:3], ', ')
    WHEN high = 1 THEN 'mixed_domain|primary domain ' || hs[1] || '; secondary signals: ' || array_to_string(ms[1:2], ', ')
    WHEN medium = 1 THEN 'single_domain|moderate ' || ms[1] || ' signal'
    ELSE 'mixed_domain|mixed moderate signals: ' || array_to_string(ms[1:3], ', ') END AS s
  FROM tot LEFT JOIN raws USING (capture_id) LEFT JOIN dom USING (capture_id))"""
ORACLE["trace_shape"] = f"""
WITH {MIX}, {RANK_EV}, {SIG_EV}, {DOMAINS}, {SIGNALS}, {SHAPE}
SELECT capture_id, split_part(s, '|', 1) AS trace_shape, split_part(s, '|', 2) AS why, signalling, counted FROM shape"""
_RANKING = f"WITH {MIX}, {RANK_EV}, {SIG_EV}, {DOMAINS}, {oracle_rank.PROFILES}, {oracle_rank.RANKED}"
ORACLE["profile_rank"] = f"{_RANKING} {oracle_rank.RANK}"
ORACLE["profile_suppressed"] = f"{_RANKING} {oracle_rank.SUPPRESSED}"
ORACLE["best_profile"] = f"{_RANKING} {oracle_rank.BEST}"
ORACLE["capture_enrichment"] = f"{_RANKING}, {SIGNALS}, {SHAPE}, {oracle_rank.ENRICHED} {oracle_rank.ENRICHMENT}"
ORACLE["naming_evidence"] = f"""
WITH {MIX},
n AS (SELECT capture_id, bool_or(name LIKE '%3gppnetwork.org%') AS net, bool_or(name LIKE '%pcscf%') AS pcscf, bool_or(name LIKE '%3gpp%') AS ctx
  FROM mix WHERE name IS NOT NULL GROUP BY 1)
SELECT capture_id, CASE WHEN net THEN 3 ELSE 0 END AS strong_names, pcscf::INT + ctx::INT AS supporting_names,
  CASE WHEN net THEN 'DNS trace matches telecom core naming — APN/realm/core service resolution support traffic; 3gppnetwork.org naming detected;'
    || ' APN/EPC MCC/MNC naming pattern detected; MCC/MNC operator naming pattern detected' || CASE WHEN pcscf THEN '; P-CSCF IMS host naming' ELSE '' END || '; 3GPP naming context'
  ELSE '' END AS naming_reasons FROM n"""
ORACLE["discovery_union"] = pkt("""
SELECT capture_id, 'ip' AS protocol, count(*) AS packets, min(frame_no) AS first_frame FROM pkt GROUP BY 1""")


# ------------------------------------------------------------------ summaries and artifacts
ORACLE["findings"] = pkt(f"""
, {DIAMETER}, {GTP}, found AS ({ALL_ANOMALIES}), layers AS (SELECT capture_id, layer, count(*) AS n FROM found GROUP BY 1, 2),
top AS (SELECT capture_id, top_protocol, count(*) AS n, row_number() OVER (PARTITION BY capture_id ORDER BY count(*) DESC, min(frame_no)) AS rn FROM pkt GROUP BY 1, 2),
g AS (SELECT *, time_rel_ms - lag(time_rel_ms) OVER (PARTITION BY capture_id ORDER BY frame_no) AS gap FROM pkt),
r AS (SELECT capture_id, gap, row_number() OVER (PARTITION BY capture_id ORDER BY gap) AS rn, count(*) OVER (PARTITION BY capture_id) AS n FROM g WHERE gap IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN gap BETWEEN 0 AND 120000 THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id ORDER BY frame_no) AS run FROM g),
b AS (SELECT capture_id, run FROM i GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT capture_id, 0 AS ord, sum(n) || ' anomalies detected (' || string_agg(layer || ': ' || n, ', ' ORDER BY layer) || ')' AS text FROM layers GROUP BY 1
UNION ALL SELECT capture_id, rn, top_protocol || ' accounts for ' || n || ' normalized packets' FROM top WHERE rn <= 3
UNION ALL SELECT capture_id, 10, 'High p95 inter-packet delay: ' || regexp_replace(CAST(CAST(round(gap, 3) AS DECIMAL(20, 3)) AS VARCHAR), '0{{1,2}}$', '')
  || ' ms — possible congestion or gaps' FROM r WHERE rn = CAST(floor((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1 AND gap > 500
UNION ALL SELECT capture_id, 11, count(*) || ' burst period(s) detected (≥5 packets within 1 s)' FROM b GROUP BY 1""")
ORACLE["capture_summary"] = pkt(f"""
, {DIAMETER}, {GTP}, found AS ({ALL_ANOMALIES}), layers AS (SELECT capture_id, layer, count(*) AS n FROM found GROUP BY 1, 2),
win AS (SELECT * FROM pkt QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) <= 500),
g AS (SELECT *, time_rel_ms - lag(time_rel_ms) OVER (PARTITION BY capture_id ORDER BY frame_no) AS gap FROM win),
r AS (SELECT capture_id, gap, row_number() OVER (PARTITION BY capture_id ORDER BY gap) AS rn, count(*) OVER (PARTITION BY capture_id) AS n FROM g WHERE gap IS NOT NULL),
slow AS (SELECT capture_id FROM r WHERE rn = CAST(floor((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1 AND gap > 500),
i AS (SELECT *, sum(CASE WHEN gap BETWEEN 0 AND 120000 THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id ORDER BY frame_no) AS run FROM g),
b AS (SELECT DISTINCT capture_id FROM (SELECT capture_id, run FROM i GROUP BY 1, 2 HAVING count(*) >= 5)),
tp AS (SELECT capture_id, string_agg(p || '=' || n, ',' ORDER BY p) AS top_protocols, count(*) AS kinds, sum(n) AS timed FROM (SELECT capture_id, top_protocol AS p, count(*) AS n FROM win GROUP BY 1, 2) GROUP BY 1),
tr AS (SELECT capture_id, string_agg(p || '=' || n, ',' ORDER BY p) AS transport, sum(n) AS total FROM (SELECT capture_id, transport AS p, count(*) AS n FROM pkt GROUP BY 1, 2) GROUP BY 1),
la AS (SELECT capture_id, string_agg(layer || '=' || n, ',' ORDER BY layer) AS layers FROM layers GROUP BY 1),
cv AS (SELECT capture_id, least(count(*), 25) AS conversations FROM ({CONVERSATIONS}) GROUP BY 1)
SELECT capture_id, CAST(total AS BIGINT) AS total_packets, top_protocols, transport, layers, conversations, total > 500 AS truncated,
  1 + least(kinds, 3) + (capture_id IN (SELECT capture_id FROM slow))::INT + (capture_id IN (SELECT capture_id FROM b))::INT AS findings, 13 AS modes, CAST(timed AS BIGINT) AS timed
FROM tp JOIN tr USING (capture_id) JOIN la USING (capture_id) JOIN cv USING (capture_id)""")
ORACLE["quality_warnings"] = pkt("""
, n AS (SELECT capture_id, count(*) AS n FROM pkt GROUP BY 1)
SELECT capture_id, 'detail_truncated' AS code, format('detail artifact contains 500 of {:,} exported packets.', n) AS message FROM n WHERE n > 500
UNION ALL SELECT capture_id, 'no_relevant_protocols_detected', 'no relevant protocols were detected in the inspected capture.' FROM n
UNION ALL SELECT capture_id, 'pseudonym_mapping_created', 'a pseudonym mapping sidecar was created and should be handled separately.' FROM n""")
ORACLE["message_excerpt"] = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id AS capture_id, least(min(n), 3) AS included_messages, min(n) AS available_messages, min(n) > 3 AS detail_excerpt_truncated,
  '[' || string_agg('{"packet_no":' || turn || ',"role":"' || role || '"' || coalesce(',"text":' || CAST(to_json(text) AS VARCHAR), '') || '}', ',' ORDER BY turn) FILTER (WHERE rn <= 3) || ']' AS messages FROM t GROUP BY 1"""
ORACLE["artifact_names"] = """
SELECT event_id, 'analyze_' || event_type || '_' || user_id || '_.._k_' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '_' ||
  CASE WHEN event_id % 3 = 0 THEN 'start_' || event_id ELSE strftime(ts, '%Y%m%d_%H%M%S') END AS prefix FROM events"""
ORACLE["next_versions"] = """
WITH v AS (SELECT DISTINCT 'analyze_u' || user_id AS artifact_prefix, 1 + (event_id * 7) % 23 AS version FROM events WHERE event_type <> 'error'),
free AS (SELECT artifact_prefix, unnest(range(1, 25)) AS version FROM (SELECT DISTINCT artifact_prefix FROM v))
SELECT artifact_prefix, min(version) AS next_version FROM free ANTI JOIN v USING (artifact_prefix, version) GROUP BY 1"""
ORACLE["status_counts"] = pkt("""
, s AS (SELECT capture_id, stream, count(*) AS n, count(*) FILTER (WHERE tcp_retransmission) AS bad FROM pkt GROUP BY 1, 2),
c AS (SELECT CASE WHEN bad > 5 THEN 'failed' WHEN n < 50 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS captures FROM s GROUP BY 1)
SELECT status, captures, CAST(sum(captures) OVER () AS BIGINT) AS total FROM c""")
ORACLE["protected_packets"] = packets("""
SELECT capture_id, packet_no, top_protocol, '[redacted]' AS time_epoch, '[redacted]' AS src_ip, '[redacted]' AS src_name, 'core' AS src_alias,
  '[redacted]' AS dst_zone, CAST(user_id AS VARCHAR) AS stream,
  CASE event_type
    WHEN 'view' THEN concat_ws(';', 'diameter.cmd.code=' || CASE WHEN k < 50 THEN '316' ELSE '318' END, 'diameter.flags=' || CASE WHEN answer THEN '0x40' ELSE '0xc0' END,
      CASE WHEN k <> 7 THEN 'diameter.flags.request=' || CASE WHEN answer THEN '0' ELSE '1' END END, 'diameter.hopbyhopid=0x' || ((k // 2) % 4),
      CASE WHEN answer THEN 'diameter.Result-Code=' || code END, 'diameter.avp=aa', 'diameter.avp=bb', 'diameter.avp_tree.diameter.Session-Id=node;' || k,
      'diameter.avp_tree.e212.imsi=26201XXXXXXXXXX (Germany)')
    WHEN 'click' THEN concat_ws(';', 'gtpv2.message_type=' || (32 + k % 4), 'gtpv2.seq=' || ((k // 4) % 3), 'gtpv2.apn=[redacted]',
      CASE k % 8 WHEN 1 THEN 'Cause : .gtpv2.cause=16' WHEN 5 THEN 'Cause : .gtpv2.cause=0x49' END)
    WHEN 'error' THEN ''
    WHEN 'purchase' THEN concat_ws(';', CASE WHEN NOT answer THEN 'http2.headers.method=POST' END, CASE WHEN NOT answer THEN 'http2.headers.path=/nsmf/' || (k % 5) END,
      CASE WHEN answer THEN 'http2.headers.status=' || http END, 'http2.streamid=' || (k % 6))
    ELSE 's1ap.procedureCode=' || (k % 50) || ';s1ap.nas_pdu_tree.nas_eps.message_type=' || CASE k % 4 WHEN 0 THEN '0x41' WHEN 1 THEN '0x42' WHEN 2 THEN '67' ELSE '0x99' END
  END AS fields FROM pk""")

# What a stream has closed: the watermark, in whole milliseconds, is ten minutes behind the latest time.
MARK = "(SELECT (max(us) // 1000 - 600000) * 1000 FROM base)"
HOUR = 3600000000


def windowed(hours: int, keys: str) -> str:
    width = hours * HOUR
    return pkt(f"""
    , w AS (SELECT pkt.*, us // {width} * {width} AS window_start FROM pkt JOIN base USING (capture_id, frame_no))
    SELECT window_start, window_start + {width} AS window_end, {keys}, count(*) AS packets, min(frame_no) AS first_frame
    FROM w WHERE window_start + {width} <= {MARK} GROUP BY ALL""")


ORACLE["stream_protocol_windows"] = windowed(6, "capture_id, top_protocol AS protocol")
ORACLE["stream_conversation_windows"] = windowed(
    24, "capture_id, transport, coalesce(src_ip, 'unknown') AS src, coalesce(dst_ip, 'unknown') AS dst, top_protocol"
)
ORACLE["stream_bursts"] = pkt(f"""
, s AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 120000000 THEN 0 ELSE 1 END AS fresh FROM base WINDOW w AS (PARTITION BY capture_id ORDER BY us, frame_no)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY capture_id ORDER BY us, frame_no) AS run FROM s)
SELECT capture_id, count(*) AS packet_count, min(frame_no) AS first_frame, min(us) AS start, max(us) AS end FROM r
GROUP BY capture_id, run HAVING count(*) >= 5 AND max(us) + 120000000 <= {MARK}""")


def timed_out(rows: str, key: str, columns: str) -> str:
    return pkt(f"""
    , m AS ({rows}),
    mark AS (SELECT (least(max(us) FILTER (ask), max(us) FILTER (NOT ask)) // 1000 - 600000) * 1000 AS us FROM m)
    SELECT capture_id, frame_no, {columns}, us AS asked_at FROM m WHERE ask AND us + {6 * HOUR} < (SELECT us FROM mark)
      AND NOT EXISTS (SELECT 1 FROM m a WHERE NOT a.ask AND a.capture_id = m.capture_id AND a.{key} = m.{key} AND a.us BETWEEN m.us AND m.us + {6 * HOUR})""")


ORACLE["stream_diameter_timeouts"] = timed_out(
    """SELECT pkt.capture_id, pkt.frame_no, us, diameter_hop_by_hop_id AS hop_by_hop, diameter_cmd_code AS cmd, coalesce(diameter_flags, '') = '192' AS ask
       FROM pkt JOIN base USING (capture_id, frame_no) WHERE diameter_cmd_code IS NOT NULL""",
    "hop_by_hop", "hop_by_hop, cmd",
)
ORACLE["stream_session_timeouts"] = timed_out(
    """SELECT pkt.capture_id, pkt.frame_no, us, gtpv2_seq_no AS seq, gtpv2_message_type = '32' AS ask
       FROM pkt JOIN base USING (capture_id, frame_no) WHERE gtpv2_message_type IN ('32', '33')""",
    "seq", "seq",
)

ORACLE["replaced_index"] = pkt("""
SELECT capture_id, frame_no, time_epoch, src_ip, dst_ip, CASE WHEN capture_id = 'c1' THEN upper(transport) ELSE transport END AS transport
FROM pkt WHERE capture_id <> 'c1' OR frame_no % 2 = 0""")
ORACLE["transport_notes"] = pkt(TRANSPORT_ANOMALIES)
ORACLE["protected_summary"] = pkt(f"""
, conv AS ({CONVERSATIONS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY packet_count DESC, first_frame) AS rank FROM conv)
SELECT capture_id, CAST(NULL AS VARCHAR) AS first_seen, CAST(rank - 1 AS INTEGER) AS place, transport,
  CASE WHEN src LIKE '%.%' THEN 'IP_' || left(sha256('ip:' || src), 8) ELSE src END AS src,
  CASE WHEN dst LIKE '%.%' THEN 'IP_' || left(sha256('ip:' || dst), 8) ELSE dst END AS dst, packet_count FROM ranked WHERE rank <= 25""")
ORACLE["summary_handoff"] = ORACLE["protected_summary"].replace("SELECT capture_id, CAST(NULL AS VARCHAR) AS first_seen,", """, shown AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) AS rn, count(*) OVER (PARTITION BY capture_id) AS n FROM pkt),
ex AS (SELECT capture_id, least(min(n), 3) AS included_messages, min(n) AS available_messages, '[' || string_agg('{"packet_no":' || frame_no ||
  coalesce(',"transport":"' || transport || '"', '') || '}', ',' ORDER BY frame_no) FILTER (WHERE rn <= 3) || ']' AS messages FROM shown GROUP BY 1)
SELECT capture_id, 'lte-core' AS profile, included_messages, available_messages, messages,""").replace("FROM ranked WHERE", "FROM ranked JOIN ex USING (capture_id) WHERE")
NETWORK = "'10.' || ((c_custkey // 256) % 256) || '.' || (c_custkey % 256) || '.0'"
ORACLE["host_file"] = f"SELECT {NETWORK} AS ip, 'host-' || c_custkey AS hostname FROM customer WHERE c_custkey % 5 < 3"
ORACLE["subnet_file"] = f"SELECT {NETWORK} || '/24' AS cidr, 'net of ' || c_custkey AS alias FROM customer WHERE c_custkey % 5 < 3 AND c_custkey % 7 > 0"
ORACLE["point_code_file"] = "SELECT 'PC-' || to_hex(c_custkey) AS point_code, 'code ' || c_custkey AS alias FROM customer WHERE c_custkey % 5 < 3"
