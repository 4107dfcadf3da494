"""DuckDB SQL of the views in ``views.py``."""

PKT = """
base AS (
  SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS capture_id, event_id + 1 AS frame_no, epoch_us(ts) AS us,
         user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
pkt AS (
  SELECT capture_id, frame_no,
    CAST(us // 1000000 AS VARCHAR) || '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') AS time_epoch,
    (us - 1704067200000000) / 1000.0::DOUBLE AS time_rel_ms,
    CASE event_type WHEN 'view' THEN 'eth:ip:sctp:diameter' WHEN 'signup' THEN 'eth:ip:sctp:s1ap:nas-eps'
      WHEN 'click' THEN 'eth:ip:udp:gtpv2' WHEN 'error' THEN 'eth:ip:udp:dns' ELSE 'eth:ip:tcp:http2:json' END AS stack,
    CASE event_type WHEN 'view' THEN 'diameter' WHEN 'signup' THEN 's1ap' WHEN 'click' THEN 'gtpv2'
      WHEN 'error' THEN 'dns' ELSE 'http' END AS top_protocol,
    '10.' || CAST(user_id % 3 AS VARCHAR) || '.' || CAST(user_id // 250 AS VARCHAR) || '.' || CAST(user_id % 250 + 1 AS VARCHAR) AS src_ip,
    CASE WHEN k = 99 THEN NULL WHEN k % 10 = 9 THEN '2001:db8::' || CAST(k % 7 + 1 AS VARCHAR)
      ELSE '192.168.' || CAST(k % 4 AS VARCHAR) || '.' || CAST(k % 7 + 1 AS VARCHAR) END AS dst_ip,
    CASE event_type WHEN 'view' THEN 'sctp' WHEN 'signup' THEN 'sctp' WHEN 'click' THEN 'udp' WHEN 'error' THEN 'udp' ELSE 'tcp' END AS transport,
    30000 + user_id AS src_port,
    CASE event_type WHEN 'view' THEN 3868 WHEN 'signup' THEN 36412 WHEN 'click' THEN 2123 WHEN 'error' THEN 53 ELSE 443 END AS dst_port,
    CAST(user_id AS VARCHAR) AS stream,
    event_type = 'purchase' AND k % 11 = 0 AS tcp_retransmission,
    event_type = 'purchase' AND k % 13 = 0 AS tcp_out_of_order,
    CASE WHEN event_type = 'view' THEN CASE WHEN k = 7 THEN NULL WHEN k % 2 = 1 THEN '0x40' ELSE '192' END END AS diameter_flags,
    CASE WHEN event_type = 'view' THEN CASE WHEN k < 50 THEN '316' ELSE '318' END END AS diameter_cmd_code,
    CASE WHEN event_type = 'view' THEN '0x' || CAST((k // 2) % 10 AS VARCHAR) END AS diameter_hop_by_hop_id,
    CASE WHEN event_type = 'view' AND k % 2 = 1 THEN CASE k % 3 WHEN 0 THEN '2001' WHEN 1 THEN '5004' ELSE '3002' END END AS diameter_result_code,
    CASE WHEN event_type = 'click' THEN CASE k % 4 WHEN 0 THEN '32' WHEN 1 THEN '33' WHEN 2 THEN '34' ELSE '26' END END AS gtpv2_message_type,
    CASE WHEN event_type = 'click' THEN CAST((k // 4) % 8 AS VARCHAR) END AS gtpv2_seq_no,
    CASE WHEN event_type = 'click' THEN CASE k % 8 WHEN 1 THEN '16' WHEN 5 THEN '0x49' END END AS gtpv2_cause,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 5 = 0 THEN 'Node' || CAST(k AS VARCHAR) || '.epc.mnc001.mcc262.3gppnetwork.org'
      ELSE 'Host' || CAST(k AS VARCHAR) || '.Example.org' END END AS dns_qry_name,
    event_type, user_id, k
  FROM base
)
"""

# every distinct endpoint with the columns of its resolution
ENDPOINTS = """
hosts AS (SELECT '10.' || (n_nationkey % 3) || '.0.' || (n_nationkey + 1) AS ip,
            ['mme', 'HSS', 'pgw-core', 'node', 'fw-dns'][n_nationkey % 5 + 1] || '-' || n_nationkey AS hostname FROM nation),
nodes AS (SELECT '192.168.' || (r_regionkey % 4) || '.' || (r_regionkey + 1) AS ip, r_regionkey AS r,
            CASE WHEN r_regionkey % 2 = 0 THEN 'smf-' || r_regionkey END AS hostname, 'NODE-' || r_name AS alias,
            CASE WHEN r_regionkey < 3 THEN lower(r_name) END AS role, 'site-' || r_regionkey AS site, r_name AS zone FROM region),
sides AS (
  SELECT capture_id, frame_no, 0 AS side, src_ip AS ip, CAST(NULL AS INTEGER) AS port, CAST(NULL AS VARCHAR) AS code FROM pkt
  UNION ALL
  SELECT capture_id, frame_no, 1, dst_ip, CASE WHEN dst_port IN (53, 80, 443, 2123, 2152, 2905, 3868, 8805, 36422, 38412, 36412) THEN dst_port END,
    'PC-' || (frame_no % 6) FROM pkt),
keys AS (SELECT DISTINCT ip, port, code FROM sides),
named AS (
  SELECT k.ip, k.port, k.code, h.hostname AS h_host, n.r AS n_r, n.hostname AS n_host, n.alias AS n_alias, n.role AS n_role, n.site AS n_site, n.zone AS n_zone,
    net.r_name AS net_alias, pc.r_name AS pc_name,
    CASE k.port WHEN 53 THEN 'dns' WHEN 443 THEN 'tls' WHEN 2123 THEN 'gtpc' WHEN 3868 THEN 'diameter' END AS port_role,
    CASE k.port WHEN 53 THEN 'DNS' WHEN 3868 THEN 'DRA' WHEN 2123 THEN 'SGW' WHEN 36412 THEN 'MME' END AS port_element,
    CASE k.port WHEN 3868 THEN 'Protocol-port heuristic is ambiguous (DRA/HSS)' WHEN 2123 THEN 'Protocol-port heuristic is ambiguous (SGW/PGW/MME)'
      WHEN 36412 THEN 'Protocol-port heuristic is ambiguous (MME/eNodeB)' END AS port_warning,
    (SELECT max(['MME', 'HSS', 'Firewall'][n_nationkey % 3 + 1]) FROM nation
      WHERE n_nationkey < 20 AND k.ip = '10.' || (n_nationkey % 3) || '.0.' || (n_nationkey + 3)) AS by_ip,
    (SELECT arg_min(['MME', 'HSS', 'Firewall'][n_nationkey % 3 + 1], n_nationkey) FROM nation
      WHERE n_nationkey >= 20 AND k.ip LIKE '192.168.' || (n_nationkey % 4) || '._') AS by_net
  FROM keys k LEFT JOIN hosts h ON h.ip = k.ip LEFT JOIN nodes n ON n.ip = k.ip
  LEFT JOIN region net ON net.r_regionkey = CASE WHEN k.ip LIKE '10.1.%' THEN 0 WHEN k.ip LIKE '10.%' THEN 1
      WHEN k.ip LIKE '192.168.0.%' OR k.ip LIKE '192.168.1.%' THEN 2 WHEN k.ip LIKE '2001:db8:%' THEN 3 END
  LEFT JOIN region pc ON 'PC-' || pc.r_regionkey = k.code),
entry AS (
  SELECT *, coalesce(n_host, CASE WHEN n_r IS NULL THEN h_host END) AS hostname,
    CASE WHEN n_r IS NOT NULL THEN n_alias WHEN h_host IS NOT NULL THEN h_host WHEN net_alias IS NOT NULL THEN net_alias WHEN pc_name IS NOT NULL THEN 'STP ' || pc_name END AS alias,
    CASE WHEN n_r IS NOT NULL THEN coalesce(n_role, port_role) WHEN h_host IS NOT NULL OR net_alias IS NOT NULL THEN port_role
      WHEN pc_name IS NOT NULL THEN 'ss7' ELSE port_role END AS role,
    CASE WHEN n_r IS NOT NULL THEN n_site END AS site, CASE WHEN n_r IS NOT NULL THEN n_zone END AS zone
  FROM named),
sig AS (
  SELECT *, CASE WHEN hostname LIKE '%HSS%' THEN 'HSS' WHEN hostname LIKE '%pgw%' THEN 'PGW' WHEN hostname LIKE '%mme%' THEN 'MME'
    WHEN hostname LIKE '%smf%' THEN 'SMF' WHEN hostname LIKE '%dns%' THEN 'DNS' END AS by_name FROM entry),
endpoints AS (
  SELECT ip, port, code, hostname, alias, role, site, zone, CASE WHEN pc_name IS NOT NULL THEN 'STP ' || pc_name END AS code_alias,
    CASE WHEN n_r = 4 THEN 'UPF' ELSE coalesce(by_ip, by_net, by_name, port_element, 'unknown') END AS element_type,
    CASE WHEN n_r = 4 THEN 100 WHEN by_ip IS NOT NULL THEN 100 WHEN by_net IS NOT NULL THEN 90 WHEN by_name IS NOT NULL THEN 80
      WHEN port_element IS NOT NULL THEN 50 ELSE 0 END AS confidence,
    CASE WHEN n_r = 4 THEN 'manual_override' WHEN by_ip IS NOT NULL THEN 'ip_mapping' WHEN by_net IS NOT NULL THEN 'subnet_mapping'
      WHEN by_name IS NOT NULL THEN 'hostname_pattern' WHEN port_element IS NOT NULL THEN 'protocol' ELSE 'unknown' END AS source,
    CASE WHEN n_r = 4 THEN NULL
      WHEN len(list_distinct(list_filter([by_ip, by_net, by_name, port_element], lambda x: x IS NOT NULL))) > 1 THEN 'Conflicting detection signals'
      ELSE port_warning END AS warning
  FROM sig)
"""

# full packets: what the packets of the trace say, one row each
PACKETS = """
base AS (
  SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS capture_id, event_id + 1 AS packet_no, epoch_us(ts) AS us,
         user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
sides AS (
  SELECT *, k % 2 = 1 AS answer, '10.0.0.' || (user_id % 12 + 1) AS client, '192.168.0.' || (k % 3 + 1) AS server,
    CASE event_type WHEN 'view' THEN 3868 WHEN 'click' THEN 2123 WHEN 'error' THEN 53 WHEN 'purchase' THEN 443 ELSE 36412 END AS port
  FROM base),
pk AS (
  SELECT *, CASE WHEN answer THEN server ELSE client END AS src_ip, CASE WHEN answer THEN client ELSE server END AS dst_ip,
    CASE WHEN answer THEN port ELSE 40000 END AS src_port, CASE WHEN answer THEN 40000 ELSE port END AS dst_port,
    CASE event_type WHEN 'view' THEN 'sctp' WHEN 'signup' THEN 'sctp' WHEN 'purchase' THEN 'tcp' ELSE 'udp' END AS proto,
    CASE event_type WHEN 'view' THEN 'eth:ip:sctp:diameter' WHEN 'signup' THEN 'eth:ip:sctp:s1ap:nas-eps'
      WHEN 'click' THEN 'eth:ip:udp:gtpv2' WHEN 'error' THEN 'eth:ip:udp:dns' ELSE 'eth:ip:tcp:http2:json' END AS stack,
    CASE event_type WHEN 'view' THEN 'diameter' WHEN 'signup' THEN 's1ap' WHEN 'click' THEN 'gtpv2' WHEN 'error' THEN 'dns' ELSE 'http' END AS top_protocol,
    CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN 'chunks=[''0'', ''3'']'
      WHEN event_type = 'purchase' THEN concat_ws(';', CASE WHEN k % 11 = 0 THEN 'retransmission' END, CASE WHEN k % 13 = 0 THEN 'out_of_order' END)
      ELSE '' END AS notes,
    CASE k % 3 WHEN 0 THEN 2001 WHEN 1 THEN 5004 ELSE 3002 END AS code,
    CASE k % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 503 END AS http,
    'DNS ' || CASE k % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'AAAA' ELSE 'TYPE99' END || ' Host' || (k % 4) || '.Example.org' AS dns
  FROM sides),
labelled AS (
  SELECT *,
    CASE event_type
      WHEN 'view' THEN 'Update-Location' || CASE WHEN k = 7 THEN '' WHEN answer THEN ' Answer' ELSE ' Request' END || ' (316)'
        || CASE WHEN answer THEN ' · Result ' || code ELSE '' END
      WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'Create Session Request (32)'
        WHEN 1 THEN 'Create Session Response (33)' || CASE k % 8 WHEN 1 THEN ' · Cause 16' ELSE ' · Cause 73 (No resources available)' END
        WHEN 2 THEN 'Modify Bearer Request (34)' ELSE 'Modify Bearer Response (35)' END
      WHEN 'error' THEN dns || CASE WHEN NOT answer THEN '' WHEN k % 10 = 3 THEN ' · NXDOMAIN' WHEN k % 4 > 0 THEN ' · NOERROR (' || (k % 4) || ' ans)' ELSE ' · NOERROR' END
      WHEN 'purchase' THEN CASE WHEN answer THEN 'HTTP ' || http || CASE http WHEN 200 THEN ' OK' WHEN 404 THEN ' Not Found' ELSE ' Service Unavailable' END
        ELSE 'POST /nsmf/' || (k % 5) END
      ELSE CASE k % 4 WHEN 0 THEN 'Attach Request' WHEN 1 THEN 'Attach Accept' WHEN 2 THEN 'Attach Complete' ELSE 'NAS-EPS 0x99' END
    END AS name0,
    CASE event_type
      WHEN 'view' THEN CASE WHEN NOT answer THEN 'request' WHEN code >= 3000 THEN 'error' ELSE 'response' END
      WHEN 'click' THEN CASE WHEN k % 8 = 5 THEN 'error' WHEN answer THEN 'response' ELSE 'request' END
      WHEN 'error' THEN CASE WHEN NOT answer THEN 'request' WHEN k % 10 = 3 THEN 'error' ELSE 'response' END
      WHEN 'purchase' THEN CASE WHEN (answer AND http >= 400) OR notes <> '' THEN 'error' ELSE 'request' END
      ELSE CASE WHEN notes <> '' THEN 'error' ELSE 'request' END
    END AS status,
    CASE event_type WHEN 'view' THEN 'diameter.hopbyhopid:0x' || ((k // 2) % 4) WHEN 'click' THEN 'gtpv2.seq:' || ((k // 4) % 3)
      WHEN 'error' THEN 'dns.id:0x' || ((k // 2) % 5) WHEN 'purchase' THEN 'http2.streamid:' || (k % 6) END AS correlation_id,
    CASE WHEN src_ip = '192.168.0.1' THEN 'alias:core-1' ELSE 'ip:' || src_ip END AS src_node,
    CASE WHEN dst_ip = '192.168.0.1' THEN 'alias:core-1' ELSE 'ip:' || dst_ip END AS dst_node
  FROM pk),
msg AS (SELECT * EXCLUDE (name0), CASE WHEN event_type = 'view' AND k >= 50 THEN replace(name0, 'Update-Location', 'Authentication-Information') ELSE name0 END AS n1 FROM labelled),
flow AS (SELECT * EXCLUDE (n1), CASE WHEN event_type = 'view' AND k >= 50 THEN replace(n1, '(316)', '(318)') ELSE n1 END AS message_name,
    (us - 1704067200000000) / 1000000.0::DOUBLE AS rel FROM msg)
"""
# runs of equal packets as events
EVENTS = """
marks AS (SELECT *, CASE WHEN lag(src_node || '|' || dst_node || '|' || message_name || '|' || top_protocol) OVER w
    = src_node || '|' || dst_node || '|' || message_name || '|' || top_protocol THEN 0 ELSE 1 END AS starts
  FROM flow WINDOW w AS (PARTITION BY capture_id ORDER BY packet_no)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY capture_id ORDER BY packet_no) AS event_no FROM marks),
ev AS (SELECT capture_id, event_no, min(packet_no) AS first_packet_no, max(packet_no) AS last_packet_no, arg_min(src_node, packet_no) AS src_node,
    arg_min(dst_node, packet_no) AS dst_node, arg_min(message_name, packet_no) AS message_name, arg_min(status, packet_no) AS status,
    arg_min(correlation_id, packet_no) AS correlation_id, count(*) AS repeat_count, arg_max(rel, packet_no) AS last_relative_ms, arg_min(rel, packet_no) AS rel
  FROM numbered GROUP BY 1, 2)
"""

# packets of other networks
ACCESS = """
base AS (
  SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS capture_id, event_id + 1 AS packet_no, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
ac AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'ngap' WHEN 'signup' THEN 'nas-5gs' WHEN 'click' THEN 'sctp' WHEN 'error' THEN 'sip' ELSE 'tcp' END AS top_protocol,
    CASE WHEN event_type = 'view' THEN '2001:db8::' || (user_id % 9 + 1) ELSE '10.1.0.' || (user_id % 12 + 1) END AS src_ip,
    CASE WHEN event_type = 'view' THEN '2001:db8::100' ELSE '10.2.0.' || (k % 3 + 1) END AS dst_ip,
    CASE event_type WHEN 'view' THEN ['7', '0xa', '77', '0'][k % 4 + 1] WHEN 'signup' THEN ['0x41', '0x42', '0x44', '0x01'][k % 4 + 1]
      WHEN 'error' THEN ['INVITE sip', '180 Ringing', 'REGISTER'][k % 3 + 1] END AS code,
    CASE event_type WHEN 'view' THEN ['InitialContextSetup (7)', 'NGSetup (10)', 'NGAP Procedure 77', 'AMFConfigurationUpdate (0)'][k % 4 + 1]
      WHEN 'signup' THEN ['Registration Request', 'Registration Accept', 'Registration Reject', 'NAS-5GS 0x01'][k % 4 + 1]
      WHEN 'error' THEN ['INVITE sip', '180 Ringing', 'REGISTER'][k % 3 + 1] WHEN 'click' THEN 'SCCP' ELSE 'TCP' END AS message_name
  FROM base
)
"""
