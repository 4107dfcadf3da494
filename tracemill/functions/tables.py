"""Code points, names and word lists defined by the protocols and rule sets.

Everything in this module is data that results depend on, written in natural order.
Code that uses it lives elsewhere.
"""

from __future__ import annotations


def _coded(text: str) -> dict[int, str]:
    """One ``code name`` pair per line."""
    rows = (line.strip().split(" ", 1) for line in text.strip().splitlines())
    return {int(code, 0): name for code, name in rows}


def _named(text: str) -> dict[str, list[str]]:
    """One ``name: words`` entry per line."""
    rows = (line.strip().split(":", 1) for line in text.strip().splitlines())
    return {name.strip(): words.split() for name, words in rows}


# ----------------------------------------------------------------- index export
# The named text columns of a packet-index export, and their separator.
INDEX_SEPARATOR = "|"
INDEX_FIELDS = """
frame.number frame.time_epoch frame.protocols
ip.src ip.dst ipv6.src ipv6.dst
sctp.srcport sctp.dstport sctp.assoc_index
tcp.srcport tcp.dstport tcp.stream tcp.analysis.retransmission tcp.analysis.out_of_order
udp.srcport udp.dstport udp.stream
diameter.flags diameter.cmd.code diameter.hop_by_hop_id diameter.hopbyhopid
diameter.Result-Code diameter.result_code diameter.resultcode
gtpv2.message_type gtpv2.seq gtpv2.seq_no gtpv2.sequence_number gtpv2.cause
dns.qry.name
""".split()

# Limits and defaults.
TRANSPORT_FALLBACK = ["sctp", "tcp", "udp", "ip", "ipv6"]
DNS_NAME_SAMPLE = 30
DETAIL_LIMIT = 1000
OVERSIZE_FACTOR = 10
INPUT_LIMIT_MIB = 250
FLOW_EVENT_CAP = 120
CONVERSATIONS_KEPT = 25
DISCOVERY_CONVERSATIONS_KEPT = 50
SCHEMA_VERSION = "1.0"
REDUCED_TRANSPORT_FIELDS = ["proto", "src_port", "dst_port", "stream", "sctp_stream", "anomaly", "notes"]

# ----------------------------------------------------------------- endpoints
# Service port -> role.
PORT_ROLES = {
    53: "dns", 80: "http", 443: "tls", 2123: "gtpc", 2152: "gtpu", 2905: "m3ua-ss7",
    3868: "diameter", 8805: "pfcp", 36422: "s1ap", 38412: "ngap",
}
# Network element types a mapping file may name.
ELEMENT_TYPES = """
HSS UDM DRA GGSN PGW SGW MME AMF SMF UPF MSS MSC eNodeB gNodeB DNS Firewall Router
""".split()
# Host-name part -> element type, first hit wins.
HOSTNAME_ELEMENTS = [
    ("hss", "HSS"), ("udm", "UDM"), ("dra", "DRA"), ("ggsn", "GGSN"), ("pgw", "PGW"), ("sgw", "SGW"),
    ("mme", "MME"), ("amf", "AMF"), ("smf", "SMF"), ("upf", "UPF"), ("mss", "MSS"), ("msc", "MSC"),
    ("enb", "eNodeB"), ("gnb", "gNodeB"), ("dns", "DNS"), ("firewall", "Firewall"), ("fw", "Firewall"),
    ("router", "Router"),
]
# Service port -> candidate element types, the first is the detected one.
PORT_ELEMENTS = {
    53: ["DNS"], 3868: ["DRA", "HSS"], 2123: ["SGW", "PGW", "MME"], 2152: ["UPF"],
    36412: ["MME", "eNodeB"], 38412: ["AMF", "gNodeB"],
}

# ----------------------------------------------------------------- privacy
# Data classes and the built-in mode sets (one mode per class, same order).
DATA_CLASSES = """
ip hostname subscriber_id msisdn imsi imei email distinguished_name token uri apn_dnn
diameter_identity payload_text
""".split()
PRIVACY_PROFILES = {
    name: dict(zip(DATA_CLASSES, modes))
    for name, modes in _named("""
internal: keep keep keep keep keep keep keep keep keep keep keep keep keep
lab: keep keep remove remove remove remove remove remove remove mask keep pseudonymize remove
llm-telecom-safe: pseudonymize pseudonymize pseudonymize pseudonymize pseudonymize pseudonymize remove pseudonymize remove mask keep pseudonymize remove
prod-safe: mask mask pseudonymize pseudonymize pseudonymize pseudonymize remove pseudonymize remove remove keep pseudonymize remove
share: pseudonymize pseudonymize pseudonymize pseudonymize pseudonymize mask mask pseudonymize remove mask keep pseudonymize mask
""").items()
}
PROTECTION_MODES = """
keep mask pseudonymize encrypt remove keep_tac_mask_serial
keep_mcc_mnc_mask_msin keep_mcc_mnc_pseudonymize_msin keep_mcc_mnc_encrypt_msin
keep_cc_ndc_mask_subscriber keep_cc_ndc_pseudonymize_subscriber keep_cc_ndc_encrypt_subscriber
""".split()
REDACTED = "[redacted]"
# Value patterns.
IP_PATTERN = (
    r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
    r"|(?i:\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b)"
)
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URI_PATTERN = r"(?:https?://|sip:|tel:|www\.)"
TOKEN_PATTERN = r"(?:bearer\s+[A-Za-z0-9._-]+|authorization|cookie|token=)"
IMSI_PATTERN = r"\b\d{14,16}\b"
MSISDN_PATTERN = r"\b(?:\+?\d{10,15})\b"
# Fixed values: (class, protocols, path parts) of the rules bound to a protocol, first hit wins.
PROTOCOL_PRIVACY_RULES = [
    ("diameter_identity", "diameter", "diameter.origin_host diameter.destination_host"),
    ("subscriber_id", "diameter", "diameter.user_name diameter.subscription"),
    ("apn_dnn", "gtpv2 nas-eps nas-5gs pfcp", "gtpv2.apn nas_eps.apn nas_5gs.dnn pfcp.dnn"),
    ("subscriber_id", "ngap nas-5gs", "ngap.suci ngap.supi nas_5gs.suci nas_5gs.supi"),
    ("imei", "ngap nas-5gs", "ngap.pei nas_5gs.pei"),
    ("token", "http2", "http2.header.authorization http2.header.cookie"),
    ("hostname", "http2 dns", "http2.header.:authority dns.qry.name"),
    ("uri", "http2", "http2.header.:path http2.header.referer"),
]
# Fixed values: (class, path parts, value pattern name) of the general rules, first hit wins.
GENERIC_PRIVACY_RULES = [
    ("ip", "src.ip dst.ip .ip ipv4 ipv6", "ip"),
    ("hostname", "hostname dns.qry.name authority src_name dst_name host", None),
    ("imsi", "imsi supi suci", None),
    ("msisdn", "msisdn", None),
    ("imei", "imei pei", None),
    ("payload_text", "payload .text message.body blob", None),
    ("email", "email", "email"),
    ("token", "token bearer cookie authorization", "token"),
    ("uri", "uri url referer :path", "uri"),
    ("apn_dnn", "apn dnn", None),
    ("hostname", "dns", None),
    ("diameter_identity", "realm origin_host destination_host origin-realm destination-realm", None),
    ("distinguished_name", "distinguished .dn issuer subject", None),
    ("subscriber_id", "subscriber .id ueid", None),
]
# Marker words of the free-text fallback.
FREE_TEXT_MARKERS = "imsi msisdn imei supi suci".split()
# Canonical class -> data classes.
CANONICAL_CLASSES = _named("""
network_address: ip hostname
subscriber_identifier: subscriber_id imsi msisdn
device_identifier: imei
operator_internal_name: hostname diameter_identity apn_dnn
application_secret: token
payload_text: payload_text email uri
""")
# Classes that must not leave in the clear.
SHARE_CHECK_CLASSES = "ip hostname imsi msisdn imei subscriber_id diameter_identity".split()
# E.164 country codes of two and of three digits; every other number starts with a code of one digit.
COUNTRY_CODES_2 = """
20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66
81 82 84 86 90 91 92 93 94 95 98
""".split()
COUNTRY_CODES_3 = """
212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244
245 246 248 249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 290 291 297 298 299
350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389
420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 593 594 595 596 597 598 599
670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692
850 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998
""".split()
# National destination codes per country code; '?' stands for any digit.
DESTINATION_CODES = {"49": "160 162 163 170 171 172 173 174 175 176 177 178 179 15".split()}
COUNTRY_BY_CALLING_CODE = {"49": "Germany"}
COUNTRY_BY_MCC = {
    "262": "Germany",
    "310": "United States of America",
    "311": "United States of America",
    "312": "United States of America",
    "313": "United States of America",
    "314": "United States of America",
    "315": "United States of America",
    "316": "United States of America",
}

# ----------------------------------------------------------------- flow labels
# GTPv2 message type -> name.
GTPV2_MESSAGES = _coded("""
1 Echo
2 Echo
32 Create Session
33 Create Session
34 Modify Bearer
35 Modify Bearer
36 Delete Session
37 Delete Session
38 Change Notification
39 Change Notification
64 Modify Bearer Command
65 Modify Bearer Failure Indication
66 Delete Bearer Command
67 Delete Bearer Failure Indication
68 Bearer Resource Command
69 Bearer Resource Failure Indication
70 DL Data Notification Failure
95 Create Bearer
96 Create Bearer
97 Update Bearer
98 Update Bearer
99 Delete Bearer
100 Delete Bearer
101 Delete PDN Connection Set
102 Delete PDN Connection Set
128 Identification
129 Identification
130 Context
131 Context
132 Context Acknowledge
133 Forward Relocation
134 Forward Relocation
135 Forward Relocation Complete Notification
136 Forward Relocation Complete Acknowledge
139 Relocation Cancel
140 Relocation Cancel
149 Detach Notification
150 Detach Acknowledge
151 CS Paging Indication
162 Suspend Notification
163 Suspend Acknowledge
164 Resume Notification
165 Resume Acknowledge
166 Create Indirect Data Forwarding Tunnel
167 Create Indirect Data Forwarding Tunnel
168 Delete Indirect Data Forwarding Tunnel
169 Delete Indirect Data Forwarding Tunnel
170 Release Access Bearers
171 Release Access Bearers
176 Downlink Data Notification
177 Downlink Data Notification Ack
179 PGW Restart Notification
180 PGW Restart Notification Ack
200 Update PDN Connection Set
201 Update PDN Connection Set
211 Modify Access Bearers
212 Modify Access Bearers
""")
# GTPv2 message types that are requests.
GTPV2_REQUESTS = [
    1, 32, 34, 36, 38, 64, 66, 68, 95, 97, 99, 101, 128, 130, 133, 135, 139, 149, 151,
    162, 164, 166, 168, 170, 176, 179, 200, 211,
]
# GTPv2 cause -> name.
GTPV2_CAUSES = _coded("""
16 Request accepted
17 Request accepted partially
18 New PDN type network preference
19 New PDN type single address bearer only
64 Context Not Found
65 Invalid Message Format
66 Version not supported
67 Invalid length
68 Service not supported
69 Mandatory IE incorrect
70 Mandatory IE missing
72 System failure
73 No resources available
78 Missing or unknown APN
82 Denied in RAT
83 Preferred PDN type not supported
84 All dynamic addresses are occupied
86 Protocol type not supported
87 UE not responding
88 UE refuses
89 Service denied
91 No memory available
92 User authentication failed
93 APN access denied - no subscription
94 Request rejected
96 IMSI/IMEI not known
100 Remote peer not responding
101 Collision with network initiated request
103 Conditional IE missing
110 Temporarily rejected (handover in progress)
113 APN Congestion
116 Multiple PDN connections for APN not allowed
""")
# Diameter command code -> name.
DIAMETER_COMMANDS = _coded("""
257 Capabilities-Exchange
258 Re-Auth
271 Accounting
272 Credit-Control
274 Abort-Session
275 Session-Termination
280 Device-Watchdog
282 Disconnect-Peer
300 User-Authorization
301 Server-Assignment
302 Location-Info
303 Multimedia-Auth
304 Registration-Termination
305 Push-Profile
306 User-Data
307 Profile-Update
308 Subscribe-Notifications
309 Push-Notification
310 Bootstrapping-Info
311 Message-Process
312 Diameter-EAP
313 AA
314 ST
315 AS
316 Update-Location
317 Cancel-Location
318 Authentication-Information
319 Insert-Subscriber-Data
320 Delete-Subscriber-Data
321 Purge-UE
322 Reset
323 Notify
324 ME-Identity-Check
325 Update-Location
326 Delete-Subscriber-Data
8388620 Spending-Limit
8388622 Re-Auth
""")
# HTTP status -> phrase (the registered ones).
HTTP_PHRASES = _coded("""
100 Continue
101 Switching Protocols
102 Processing
103 Early Hints
200 OK
201 Created
202 Accepted
203 Non-Authoritative Information
204 No Content
205 Reset Content
206 Partial Content
207 Multi-Status
208 Already Reported
226 IM Used
300 Multiple Choices
301 Moved Permanently
302 Found
303 See Other
304 Not Modified
305 Use Proxy
307 Temporary Redirect
308 Permanent Redirect
400 Bad Request
401 Unauthorized
402 Payment Required
403 Forbidden
404 Not Found
405 Method Not Allowed
406 Not Acceptable
407 Proxy Authentication Required
408 Request Timeout
409 Conflict
410 Gone
411 Length Required
412 Precondition Failed
413 Content Too Large
414 URI Too Long
415 Unsupported Media Type
416 Range Not Satisfiable
417 Expectation Failed
418 I'm a Teapot
421 Misdirected Request
422 Unprocessable Content
423 Locked
424 Failed Dependency
425 Too Early
426 Upgrade Required
428 Precondition Required
429 Too Many Requests
431 Request Header Fields Too Large
451 Unavailable For Legal Reasons
500 Internal Server Error
501 Not Implemented
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
505 HTTP Version Not Supported
506 Variant Also Negotiates
507 Insufficient Storage
508 Loop Detected
510 Not Extended
511 Network Authentication Required
""")
# NGAP procedure code -> name.
NGAP_PROCEDURES = _coded("""
0 AMFConfigurationUpdate
4 HandoverCancel
5 HandoverPreparation
6 HandoverResourceAllocation
7 InitialContextSetup
9 NGReset
10 NGSetup
11 PathSwitchRequest
12 PDUSessionResourceModify
13 PDUSessionResourceModifyIndication
14 PDUSessionResourceRelease
15 PDUSessionResourceSetup
16 PWSCancel
17 RANConfigurationUpdate
18 UEContextModification
19 UEContextRelease
20 UERadioCapabilityCheck
21 WriteReplaceWarning
22 AMFStatusIndication
23 CellTrafficTrace
24 DeactivateTrace
25 DownlinkNASTransport
26 DownlinkNonUEAssociatedNRPPaTransport
27 DownlinkRANConfigurationTransfer
28 DownlinkRANStatusTransfer
29 DownlinkUEAssociatedNRPPaTransport
30 ErrorIndication
31 HandoverNotification
32 InitialUEMessage
33 LocationReportingControl
34 LocationReportingFailureIndication
35 LocationReport
36 NASNonDeliveryIndication
37 OverloadStart
38 OverloadStop
39 Paging
40 PDUSessionResourceNotify
41 PrivateMessage
42 PWSFailureIndication
43 PWSRestartIndication
44 RerouteNASRequest
45 RRCInactiveTransitionReport
46 TraceFailureIndication
47 TraceStart
48 UEContextReleaseRequest
49 UEInformationTransfer
50 UERadioCapabilityInfoIndication
51 UETNLABindingRelease
52 UplinkNASTransport
53 UplinkNonUEAssociatedNRPPaTransport
54 UplinkRANConfigurationTransfer
55 UplinkRANStatusTransfer
56 UplinkUEAssociatedNRPPaTransport
""")
# EPS NAS message type -> name.
NAS_EPS_MESSAGES = _coded("""
0x41 Attach Request
0x42 Attach Accept
0x43 Attach Complete
0x44 Attach Reject
0x45 Detach Request
0x46 Detach Accept
0x48 Tracking Area Update Request
0x49 Tracking Area Update Accept
0x4a Tracking Area Update Complete
0x4b Tracking Area Update Reject
0x4c Extended Service Request
0x4d Service Reject
0x4e Service Request
0x50 GUTI Reallocation Command
0x51 GUTI Reallocation Complete
0x52 Authentication Request
0x53 Authentication Response
0x54 Authentication Reject
0x55 Identity Request
0x56 Identity Response
0x5c Authentication Failure
0x5d Security Mode Command
0x5e Security Mode Complete
0x5f Security Mode Reject
0x60 EMM Status
0x61 EMM Information
0x62 Downlink NAS Transport
0x63 Uplink NAS Transport
0xc1 Activate Default EPS Bearer Context Request
0xc2 Activate Default EPS Bearer Context Accept
0xc3 Activate Default EPS Bearer Context Reject
0xc5 Activate Dedicated EPS Bearer Context Request
0xc6 Activate Dedicated EPS Bearer Context Accept
0xc7 Activate Dedicated EPS Bearer Context Reject
0xc9 Modify EPS Bearer Context Request
0xca Modify EPS Bearer Context Accept
0xcb Modify EPS Bearer Context Reject
0xcd Deactivate EPS Bearer Context Request
0xce Deactivate EPS Bearer Context Accept
0xd0 PDN Connectivity Request
0xd1 PDN Connectivity Reject
0xd2 PDN Disconnect Request
0xd3 PDN Disconnect Reject
""")
# 5GS NAS message type -> name.
NAS_5GS_MESSAGES = _coded("""
0x41 Registration Request
0x42 Registration Accept
0x43 Registration Complete
0x44 Registration Reject
0x45 Deregistration Request (UE originating)
0x46 Deregistration Accept (UE originating)
0x47 Deregistration Request (UE terminated)
0x48 Deregistration Accept (UE terminated)
0x4c Service Request
0x4d Service Reject
0x4e Service Accept
0x54 Configuration Update Command
0x55 Configuration Update Complete
0x56 Authentication Request
0x57 Authentication Response
0x58 Authentication Reject
0x59 Authentication Failure
0x5a Authentication Result
0x5b Identity Request
0x5c Identity Response
0x5d Security Mode Command
0x5e Security Mode Complete
0x5f Security Mode Reject
0x64 5GMM Status
0x65 Notification
0x66 Notification Response
0x67 UL NAS Transport
0x68 DL NAS Transport
0xc1 PDU Session Establishment Request
0xc2 PDU Session Establishment Accept
0xc3 PDU Session Establishment Reject
0xc5 PDU Session Authentication Command
0xc6 PDU Session Authentication Complete
0xc7 PDU Session Authentication Result
0xc9 PDU Session Modification Request
0xca PDU Session Modification Reject
0xcb PDU Session Modification Command
0xcc PDU Session Modification Complete
0xcd PDU Session Modification Command Reject
0xd1 PDU Session Release Request
0xd2 PDU Session Release Reject
0xd3 PDU Session Release Command
0xd4 PDU Session Release Complete
0xd6 5GSM Status
""")
# DNS query type and response code names.
DNS_TYPES = _coded("""
1 A
2 NS
5 CNAME
6 SOA
12 PTR
15 MX
16 TXT
28 AAAA
33 SRV
35 NAPTR
41 OPT
43 DS
46 RRSIG
47 NSEC
48 DNSKEY
52 TLSA
65 HTTPS
255 ANY
""")
DNS_RCODES = _coded("""
0 NOERROR
1 FORMERR
2 SERVFAIL
3 NXDOMAIN
4 NOTIMP
5 REFUSED
6 YXDOMAIN
7 YXRRSET
8 NXRRSET
9 NOTAUTH
10 NOTZONE
""")
# Protocol-stack member -> label of last resort.
STACK_LABELS = {
    "sip": "SIP", "ngap": "NGAP", "nas-5gs": "NAS-5GS", "nas_5gs": "NAS-5GS", "s1ap": "S1AP", "pfcp": "PFCP",
    "gtpv2": "GTPv2", "gtpv1": "GTPv1", "diameter": "Diameter", "radius": "RADIUS", "sccp": "SCCP",
    "map": "MAP", "isup": "ISUP",
}
# Fields that can carry a correlation id, first non-empty wins.
CORRELATION_FIELDS = """
diameter.hopbyhopid diameter.endtoendid http2.streamid gtpv2.seq gtpv2.seq_no gtpv2.sequence_number
pfcp.sequence_number nas_eps.procedure_transaction_id ngap.AMF_UE_NGAP_ID ngap.RAN_UE_NGAP_ID dns.id
""".split()
# Words that mark errors and responses, and endings cut from a message name.
ERROR_WORDS = ["reject", "failure", "error", "timeout"]
RESPONSE_WORDS = ["response", "answer", "resp", "ack"]
RESPONSE_HINTS = [" response", " answer", " ack", " complete", "accept", "success", " aia"]
NAME_ENDINGS = [" response", " answer", " resp", " request", " req"]
# Lane priority of an endpoint role, per family.
LANE_PRIORITY = {
    "5g": {"ue": 10, "gnb": 20, "amf": 30, "smf": 40, "upf": 50, "ausf": 60, "udm": 70, "udr": 80, "pcf": 90,
           "chf": 100, "dns": 110},
    "lte": {"ue": 10, "enb": 20, "mme": 30, "sgw": 40, "pgw": 50, "hss": 60, "pcrf": 70, "msc": 80, "dns": 90},
    "ims": {"ue": 10, "p-cscf": 20, "i-cscf": 30, "s-cscf": 40, "hss": 50, "as": 60, "sbc": 70},
    "generic": {"ue": 10, "gnb": 20, "enb": 20, "mme": 30, "amf": 30, "smf": 40, "upf": 50, "sgw": 40, "pgw": 50,
                "hss": 60, "ausf": 60, "udm": 70, "udr": 80, "pcf": 90, "chf": 100, "dns": 110},
}
OTHER_LANE = 500
# Phase rules (words, kind, label); family rules come before the general ones.
FAMILY_PHASES = {
    "5g": [
        (["registration", "initial ue", "ng setup"], "registration", "Registration"),
        (["nsmf", "createsmcontext", "pdu session", "pfcp"], "session_setup", "Session Setup"),
    ],
    "lte": [
        (["attach", "initial ue", "downlink nas transport"], "registration", "Registration"),
        (["create session", "modify bearer", "gtpv2"], "session_setup", "Session Setup"),
    ],
    "ims": [
        (["register", "401", "407", "challenge"], "authentication", "Authentication"),
        (["invite", "183", "180", "200 ok", "bye"], "signaling", "Call Signaling"),
    ],
}
GENERAL_PHASES = [
    (["reject", "fail", "error", "timeout", "401", "403", "500"], "failure", "Failure / Retry"),
    (["auth", "air", "aia", "aka", "eap"], "authentication", "Authentication"),
    (["security", "smc", "security mode"], "security", "Security Mode"),
    (["session", "createsmcontext", "create session", "pfcp"], "session_setup", "Session Setup"),
    (["register", "attach", "initial ue"], "registration", "Registration"),
    (["release", "detach", "delete session"], "release", "Release"),
]
