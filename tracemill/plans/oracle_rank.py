"""DuckDB SQL of the profile ranking and of what follows from it.

All values stand here once more, as plain text: nothing is taken from the code under test.
"""

from __future__ import annotations

# Profile | relevant protocols | priority.
CATALOGUE = """
2g3g-bssap | bssap bssmap dtap sccp mtp3 | bssap bssmap dtap sccp mtp3 ip
2g3g-cap | cap tcap sccp mtp3 | cap tcap sccp mtp3 ip
2g3g-dns | dns tcp udp ip | dns tcp udp ip
2g3g-geran | bssap dtap gsm_a sccp mtp3 | bssap dtap gsm_a sccp mtp3 ip
2g3g-gn | gtpv1 gtp icmp udp ip | gtpv1 gtp icmp udp ip
2g3g-gp | gtpv1 gtp udp ip | gtpv1 gtp udp ip
2g3g-gr | map tcap sccp mtp3 ss7 | map tcap sccp mtp3 ss7 ip
2g3g-gs | bssap+ dtap sccp mtp3 ss7 | bssap+ dtap sccp mtp3 ss7 ip
2g3g-isup | isup mtp3 ss7 | isup mtp3 ss7 ip
2g3g-map-core | map tcap sccp mtp3 | map tcap sccp mtp3 ip
2g3g-sccp-mtp | sccp mtp3 ss7 | sccp mtp3 ss7 ip
2g3g-ss7-geran | map cap isup bssap gsm_a.dtap tcap sccp m3ua dns | map cap isup bssap gsm_a.dtap tcap sccp m3ua dns sctp tcp udp ip
5g-cbc-cbs | sbcap sctp ip | sbcap sctp ip
5g-core | pfcp ngap nas-5gs http dns tls | pfcp ngap nas-5gs http dns tls sctp tcp udp ip
5g-dns | dns tcp udp ip | dns tcp udp ip
5g-n1-n2 | ngap nas-5gs sctp | ngap nas-5gs sctp ip
5g-n10 | http json tcp ip | http json tcp ip
5g-n11 | http json tcp ip | http json tcp ip
5g-n12 | http json tcp ip | http json tcp ip
5g-n13 | http json tcp ip | http json tcp ip
5g-n14 | http json tcp ip | http json tcp ip
5g-n15 | http json tcp ip | http json tcp ip
5g-n16 | http json tcp ip | http json tcp ip
5g-n2 | ngap sctp ip | ngap sctp ip
5g-n22 | http json tcp ip | http json tcp ip
5g-n26 | gtpv2 http json udp tcp ip | gtpv2 http json udp tcp ip
5g-n40 | http json tcp ip | http json tcp ip
5g-n8 | http json tcp ip | http json tcp ip
5g-nas-5gs | nas-5gs ngap sctp | nas-5gs ngap sctp ip
5g-sbi | http json tcp ip | http json tcp ip
5g-sbi-auth | http json tcp ip | http json tcp ip
core-name-resolution | dns udp tcp ip | dns udp tcp ip
lte-core | diameter gtpv2 s1ap nas-eps dns tls http | diameter gtpv2 s1ap nas-eps dns tls http sctp tcp udp ip
lte-dns | dns tcp udp ip | dns tcp udp ip
lte-s1 | s1ap nas-eps sctp | s1ap nas-eps sctp ip
lte-s1-nas | nas-eps s1ap sctp | nas-eps s1ap sctp ip
lte-s10 | gtpv2 udp ip | gtpv2 udp ip
lte-s11 | gtpv2 udp ip | gtpv2 udp ip
lte-s5 | gtpv2 gtp udp ip | gtpv2 gtp udp ip
lte-s6a | diameter sctp | diameter sctp ip
lte-s8 | gtpv2 gtp udp ip | gtpv2 gtp udp ip
lte-sbc-cbc | sbcap sctp ip | sbcap sctp ip
lte-sgs | sgsap sctp ip | sgsap sctp ip
transport-core | tcp udp sctp ip ipv6 icmp | sctp tcp udp icmp ip ipv6
transport-sctp | sctp ip ipv6 | sctp ip ipv6
transport-tcp | tcp ip ipv6 tls | tcp tls ip ipv6
transport-udp | udp ip ipv6 icmp dns | udp dns icmp ip ipv6
volte-diameter-cx | diameter sctp tcp ip | diameter sctp tcp ip
volte-diameter-rx | diameter sctp tcp ip | diameter sctp tcp ip
volte-diameter-sh | diameter sctp tcp ip | diameter sctp tcp ip
volte-dns | dns udp tcp ip | dns udp tcp ip
volte-ims-core | sip diameter dns tcp udp sctp ip | sip diameter dns sctp tcp udp ip
volte-rtp-signaling | sip sdp rtp rtcp udp ip | sip sdp rtp rtcp udp ip
volte-sbc | sip dns tcp udp ip | sip dns tcp udp ip
volte-sip | sip dns tcp udp ip | sip dns tcp udp ip
volte-sip-call | sip dns tcp udp ip | sip dns tcp udp ip
volte-sip-register | sip dns tcp udp ip | sip dns tcp udp ip
vonr-dns | dns udp tcp ip | dns udp tcp ip
vonr-ims-core | sip http json dns ngap nas-5gs tcp udp sctp ip | sip http ngap nas-5gs json dns sctp tcp udp ip
vonr-n1-n2-voice | ngap nas-5gs sctp ip | ngap nas-5gs sctp ip
vonr-policy | http json tcp ip | http json tcp ip
vonr-sbc | sip dns tcp udp ip | sip dns tcp udp ip
vonr-sbi-auth | http json tcp ip | http json tcp ip
vonr-sbi-pdu | http json tcp ip | http json tcp ip
vonr-sip | sip dns tcp udp ip | sip dns tcp udp ip
vonr-sip-call | sip dns tcp udp ip | sip dns tcp udp ip
vonr-sip-register | sip dns tcp udp ip | sip dns tcp udp ip
"""
# Protocols needed | domain | score.
COMBOS = """
ngap nas-5gs sctp | 5g-sa-core | 0.95
ngap nas-5gs | 5g-sa-core | 0.88
ngap sctp | 5g-sa-core | 0.80
ngap | 5g-sa-core | 0.55
nas-5gs | 5g-sa-core | 0.45
http json | 5g-sa-core-sbi | 0.65
http | 5g-sa-core-sbi | 0.40
s1ap nas-eps sctp | lte-eps | 0.95
s1ap nas-eps | lte-eps | 0.88
s1ap sctp | lte-eps | 0.80
s1ap | lte-eps | 0.55
diameter sctp | lte-eps | 0.72
diameter | lte-eps | 0.50
gtpv2 udp | lte-eps | 0.70
gtpv2 | lte-eps | 0.55
sip sdp | ims-voice | 0.90
sip dns | ims-voice | 0.72
sip | ims-voice | 0.55
bssap dtap sccp | legacy-2g3g | 0.88
bssap dtap mtp3 | legacy-2g3g | 0.88
bssap dtap ss7 | legacy-2g3g | 0.84
map tcap sccp | legacy-2g3g | 0.92
sccp tcap mtp3 | legacy-2g3g | 0.84
sccp tcap ss7 | legacy-2g3g | 0.82
sccp mtp3 | legacy-2g3g | 0.52
gtpv1 udp | legacy-2g3g-gprs | 0.70
dns | dns-support | 0.40
"""
# Protocols that say nothing about the domain, and words looked for in peer names.
CARRIERS = "ip ipv6 tcp udp sctp eth ethertype vlan frame data arp ppp pppoe pppoed pppoes lcp ipcp pap chap wlan wlan_radio radiotap ieee80211 llc sll null loop"
WORDS = (
    "pcscf scscf icscf registrar register auth aka hss sbc ibcf ebcf session-border border-controller ims cscf tas bgcf as mmtel s6a mme s5 s8 s5-s8 pgw sgw spgw"
    " roaming s10 inter-mme relocation s11 n26 interworking amf smf pcf udm ausf nrf ngap n2 5g enb lte s1 s6 nssf scp udr sm-context pdu af service policy"
)
SBI = """
5g-n10: smf udm udr
5g-n11: amf smf sm-context pdu
5g-n12: amf ausf
5g-n13: amf udm udr
5g-n14: amf pcf
5g-n15: amf pcf af
5g-n16: smf pcf
5g-n22: amf nssf
5g-n40: smf nrf service
5g-n8: udm ausf
5g-sbi-auth: ausf udm udr auth
vonr-policy: pcf policy ims
vonr-sbi-auth: ausf auth ims
vonr-sbi-pdu: smf pdu ims
"""


def items(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


def table(text: str):
    return [[part.strip() for part in line.split("|")] for line in text.strip().splitlines()]


def combo_values() -> str:
    return ", ".join(f"({i}, {items(need)}, '{domain}', {score}::DOUBLE)" for i, (need, domain, score) in enumerate(table(COMBOS)))


PROFILES = f"""
cat(profile, relevant, priority) AS (VALUES {", ".join(f"('{n}', {items(r)}, {items(p)})" for n, r, p in table(CATALOGUE))}),
prof AS (SELECT profile, relevant, profile = 'core-name-resolution' AS naming,
  CASE WHEN profile = 'core-name-resolution' THEN 'cross-family' WHEN profile LIKE 'lte-%' THEN 'lte' WHEN profile LIKE '5g-%' THEN '5g'
    WHEN profile LIKE 'volte-%' OR profile LIKE 'vonr-%' THEN 'voice' WHEN profile LIKE '2g3g-%' THEN '2g3g' ELSE 'generic' END AS family,
  CASE WHEN profile = 'core-name-resolution' THEN 'core-support' WHEN profile LIKE 'lte-%' THEN 'eps' WHEN profile LIKE '5g-%' THEN '5g-sa-core'
    WHEN profile LIKE 'volte-%' THEN 'volte-eps' WHEN profile LIKE 'vonr-%' THEN 'vonr-5gs' WHEN profile LIKE '2g3g-%' THEN 'legacy-core' ELSE 'mixed' END AS profile_domain,
  CASE WHEN profile = 'core-name-resolution' THEN 'name-resolution'
    WHEN regexp_matches(profile, '^(lte|5g|volte|vonr|2g3g)-') THEN regexp_replace(profile, '^(lte|5g|volte|vonr|2g3g)-', '') END AS interface,
  CASE WHEN profile = 'core-name-resolution' THEN ['dns'] ELSE priority[1:2] END AS strong,
  CASE WHEN profile = 'core-name-resolution' THEN ['dns', 'udp', 'tcp'] ELSE list_sort(list_distinct(relevant)) END AS triggers,
  CASE WHEN profile = 'core-name-resolution' THEN ['udp', 'tcp'] ELSE relevant[3:4] END AS weak FROM cat)"""


# ------------------------------------------------------------------ conditions
def has(text: str) -> str:
    return f"list_has_any(present, {items(text)})"


def every(text: str) -> str:
    return f"list_has_all(present, {items(text)})"


def hint(text: str) -> str:
    return f"list_has_any(hints, {items(text)})"


def named(text: str) -> str:
    return f"list_contains({items(text)}, profile)"


def roles(text: str) -> str:
    return f"list_has_all(roles, {items(text)})"


IMS = hint("ims cscf pcscf scscf icscf sbc tas bgcf as mmtel")
VOICE = has("sip sdp rtp rtcp")
CALL = has("sdp rtp rtcp")
REGISTER = f"({hint('pcscf scscf icscf registrar register auth aka hss')} OR ({IMS} AND {has('diameter dns')}))"
SBC = f"(list_contains(roles, 'sbc') OR {hint('sbc ibcf ebcf session-border border-controller')})"
PARTNERS = has("bssap bssmap sccp mtp3 ss7 map tcap cap gtpv1")
LEGACY = "(" + " OR ".join(every(c) for c in ("bssap dtap sccp", "bssap dtap mtp3", "bssap dtap ss7", "map tcap sccp", "sccp tcap mtp3", "sccp tcap ss7", "gtpv1 udp")) + ")"
DTAP = "list_contains(matched, 'dtap')"
DTAPS = "coalesce(ev['dtap'].p, 0)"
GERAN = has("bssap bssap+ bssmap dtap gsm_a")
BSSAP = has("bssap bssap+ bssmap")
N26 = hint("n26 interworking amf mme")
BETWEEN = f"(({has('gtpv2')} AND {has('http json ngap nas-5gs')}) OR {N26})"
EPS = f"({has('gtpv2')} AND NOT {has('ngap nas-5gs')})"
HYBRID = "vonr-n1-n2-voice vonr-ims-core"
CX, CORE = "volte-diameter-cx volte-diameter-rx volte-diameter-sh", "vonr-ims-core"
NO_IMS = f"NOT ({VOICE} OR {IMS})"
SIPS = "volte-sbc volte-sip volte-sip-call volte-sip-register vonr-sbc vonr-sip vonr-sip-call vonr-sip-register"
SBI_ROWS = [line.split(": ") for line in SBI.strip().splitlines()]
SBI_HINT = "CASE profile " + " ".join(f"WHEN '{p}' THEN {hint(w)}" for p, w in SBI_ROWS) + f" ELSE {hint('amf smf pcf udm ausf nrf nssf scp')} END"
ANY_SBI = hint(" ".join(w for _, w in SBI_ROWS))
SPECIFIC = f"(NOT {named('5g-sbi 5g-core 5g-n26')} AND list_has_all(relevant, ['http', 'json']))"

GATES = [
    (f"family = '2g3g' AND {DTAP} AND NOT {PARTNERS}", 0.12, "DTAP gated: no BSSAP/SCCP/MTP3 partners"),
    (f"family = '2g3g' AND NOT ({DTAP} AND NOT {PARTNERS}) AND NOT {LEGACY}", 0.45, "legacy evidence partial: no strong SS7 partner combo"),
    (f"family = '2g3g' AND {DTAP} AND {DTAPS} > 0 AND {DTAPS} < greatest(5, floor(total * 0.01::DOUBLE)) AND NOT {LEGACY}", 0.5,
     "rare dtap signal treated as a side signal"),
    (f"{named(HYBRID)} AND NOT {VOICE}", 0.35, "voice profile downranked: no SIP/IMS indicators"),
    (f"profile LIKE 'vonr-%' AND NOT {named(HYBRID)} AND NOT {has('ngap nas-5gs')}", 0.3, "VoNR profile downranked: no 5G SA context (ngap/nas-5gs) detected"),
    (f"profile = 'volte-ims-core' AND {NO_IMS}", 0.3, "IMS Diameter/core profile downranked: no IMS peer or signaling hints"),
    (f"{named(CX)} AND {NO_IMS}", 0.35, "IMS Diameter profile downranked: no IMS peer or signaling hints"),
    (f"{named(CORE)} AND {NO_IMS}", 0.3, "IMS core profile downranked: no IMS peer or signaling hints"),
    (f"{named('volte-ims-core vonr-ims-core')} AND {VOICE} AND NOT ({has('diameter')} OR {IMS})", 0.4,
     "IMS core profile downranked: SIP alone is insufficient — Diameter or IMS peer evidence needed"),
    (f"{named(SIPS)} AND NOT ({has('sip')} OR {IMS})", 0.12, "SIP voice profile downranked: no SIP or IMS hints"),
    (f"profile LIKE '%-sip-call' AND NOT {CALL}", 0.4, "SIP call profile downranked: no SDP/media call markers"),
    (f"profile LIKE '%-sip-register' AND NOT {REGISTER}", 0.25, "SIP register profile downranked: no registrar/auth-style context"),
    (f"profile LIKE '%-sbc' AND NOT {SBC}", 0.35, "SBC profile downranked: no SBC peer or topology hints"),
    (f"{named('volte-dns vonr-dns')} AND NOT ({has('sip')} OR {IMS})", 0.55, "voice DNS profile downranked: no IMS hints"),
    (f"profile = '5g-n26' AND NOT {BETWEEN} AND {EPS}", 0.1, "N26 profile suppressed: clear EPS/GTPv2 context without any 5GC indicators"),
    (f"profile = '5g-n26' AND NOT {BETWEEN} AND NOT {EPS}", 0.3, "N26 profile downranked: no EPC↔5GC interworking hints"),
    (f"profile = '5g-dns' AND NOT ({has('ngap nas-5gs')} OR {hint('amf smf pcf udm ausf nrf ngap n2 5g')})", 0.4,
     "5G DNS profile downranked: no 5G anchor (ngap/nas-5gs) detected"),
    (f"profile = 'lte-dns' AND NOT ({has('s1ap nas-eps diameter gtpv2')} OR {hint('mme sgw pgw hss enb lte s1 s6 s11')})", 0.4,
     "LTE DNS profile downranked: no LTE anchor (s1ap/diameter/gtpv2) detected"),
    (f"profile LIKE '%-dns' AND NOT {named('lte-dns 5g-dns')} AND NOT {IMS} AND NOT {has('ngap nas-5gs s1ap nas-eps sip sdp')}", 0.25,
     "family-specific DNS profile downranked: no domain context beyond DNS"),
    (f"profile = '2g3g-isup' AND NOT {has('isup')}", 0.0, "ISUP profile suppressed: no isup protocol evidence detected"),
    (f"profile = '2g3g-bssap' AND NOT {BSSAP}", 0.0, "BSSAP profile suppressed: no BSSAP/BSSMAP evidence"),
    (f"profile = '2g3g-geran' AND NOT {GERAN}", 0.0, "GERAN profile suppressed: no BSSAP/DTAP/GSM-A evidence"),
    (f"profile = '2g3g-ss7-geran' AND NOT {GERAN}", 0.0, "legacy GERAN bundle suppressed: no BSSAP/DTAP/GSM-A evidence"),
    (f"profile = '2g3g-gs' AND NOT ({BSSAP} OR {has('dtap')})", 0.0, "Gs interface profile suppressed: no BSSAP/DTAP evidence"),
    (f"profile = '2g3g-gn' AND NOT {has('gtpv1 gtp')}", 0.0, "Gn profile not applicable: no GTPv1 evidence detected"),
    (f"profile = '2g3g-gn' AND {has('gtpv1 gtp')} AND {has('gtpv2')}", 0.0,
     "Gn profile not applicable: GTPv2 control plane present — GTP user-plane is LTE-U, not legacy Gn"),
    (f"profile = '2g3g-gp' AND NOT {has('gtpv1 gtp')}", 0.0, "Gp profile not applicable: no GTPv1 evidence detected"),
    (f"profile = '2g3g-gp' AND {has('gtpv1 gtp')} AND {has('gtpv2')}", 0.0,
     "Gp profile not applicable: GTPv2 control plane present — GTP user-plane is LTE-U, not legacy Gp/roaming"),
    (f"{named('lte-s5 lte-s8')} AND {has('gtpv1 gtp')} AND NOT {has('gtpv2')}", 0.12,
     "lte-s5/s8 downranked: GTP (v1) without GTPv2 control plane — suggests legacy Gn/Gp, not LTE S5/S8"),
    (f"{SPECIFIC} AND NOT ({SBI_HINT})", 0.3, "specific SBI interface downranked because no NF or interface hints were detected"),
]
PARTIAL = "protocol evidence is partial; resolved peer hints "
BONUSES = [
    (f"{named(CX + ' volte-ims-core')} AND {IMS}", 0.6, "resolved peer hints reinforce IMS/CSCF Diameter context"),
    (f"{named('volte-ims-core vonr-ims-core')} AND {has('diameter')} AND {IMS}", 1.0, "Diameter plus IMS peer hints support broad IMS core context"),
    (f"profile LIKE '%-sip-call' AND {CALL}", 0.9, "SDP/media markers support call-flow specialization"),
    (f"profile LIKE '%-sip-register' AND {REGISTER}", 0.8, "registrar/auth-style hints support registration specialization"),
    (f"profile LIKE '%-sbc' AND {SBC}", 0.9, "resolved peer hints support SBC boundary interpretation"),
    (f"profile = 'lte-s6a' AND ({roles('mme hss')} OR {hint('s6a mme hss')})", 1.2, PARTIAL + "strongly suggest MME/HSS Diameter context"),
    (f"{named('lte-s5 lte-s8')} AND ({roles('sgw pgw')} OR {hint('s5 s8 s5-s8 pgw sgw spgw roaming')})", 1.5, PARTIAL + "strongly suggest S5/S8 context"),
    (f"profile = 'lte-s11' AND ({roles('mme sgw')} OR {hint('s11 mme sgw')})", 1.1, PARTIAL + "suggest S11 MME↔SGW context"),
    (f"profile = 'lte-s10' AND {hint('s10 inter-mme relocation')}", 1.1, PARTIAL + "suggest S10 inter-MME context"),
    (f"profile = '5g-n26' AND {N26}", 1.0, PARTIAL + "suggest EPC↔5GC interworking context"),
    (f"{named('volte-dns vonr-dns')} AND {IMS}", 0.8, PARTIAL + "suggest IMS-oriented DNS context"),
    (f"{named('2g3g-map-core 2g3g-gr')} AND {every('map tcap sccp')}", 0.5, "strong MAP/TCAP/SCCP combo supports core SS7 context"),
    (f"profile = '5g-sbi' AND {every('http json')} AND NOT {ANY_SBI}", 1.2, "generic SBI candidate favored because no specific NF/interface hints were detected"),
    (f"profile = '5g-core' AND {every('http json')} AND NOT {ANY_SBI}", 2.0,
     "generic 5G core candidate kept prominent because SBI traffic is broad but unspecific"),
]
SA = "top_domain IN ('5g-sa-core', '5g-sa-core-sbi')"
ANCHOR = has("s1ap diameter gtpv2")
MISMATCHES = [
    (f"family = 'lte' AND {SA} AND {has('nas-eps')} AND NOT {ANCHOR}", 0.35, "'treated as cross-generation side signal; primary domain evidence points to ' || top_domain"),
    (f"family = 'lte' AND {SA} AND NOT {has('nas-eps')} AND NOT {ANCHOR}", 0.15, "'LTE profile suppressed: no LTE anchor signal in strongly 5G SA dominated trace'"),
    ("family = '2g3g' AND top_family IN ('5g', 'lte') AND NOT list_contains(families, '2g3g')", 0.25, "'strong ' || top_domain || ' evidence outweighs weak legacy side signals'"),
    ("family IN ('5g', 'lte') AND top_family = '2g3g' AND NOT list_contains(families, family)", 0.35, "'strong ' || top_domain || ' evidence outweighs weak modern side signals'"),
    ("profile LIKE 'vonr-%' AND top_domain = 'lte-eps' AND NOT list_contains(families, '5g')", 0.55,
     "'voice-over-5GS profile downranked because primary domain evidence points to LTE/EPS'"),
    ("profile LIKE 'volte-%' AND top_family = '5g' AND NOT list_contains(families, 'lte')", 0.55, "'VoLTE/EPS voice profile downranked because primary domain evidence points to 5G SA'"),
    (f"(profile LIKE 'vonr-%' OR profile LIKE 'volte-%') AND top_family = '5g' AND NOT {VOICE}", 0.2,
     "'voice profile suppressed: primary domain is 5G SA with no voice evidence detected'"),
]


def family_of(domain: str) -> str:
    return (
        f"CASE {domain} WHEN '5g-sa-core' THEN '5g' WHEN '5g-sa-core-sbi' THEN '5g' WHEN 'lte-eps' THEN 'lte' WHEN 'ims-voice' THEN 'voice'"
        " WHEN 'legacy-2g3g' THEN '2g3g' WHEN 'legacy-2g3g-gprs' THEN '2g3g' END"
    )


def said(p: str) -> str:
    return f"{p} || CASE WHEN ev[{p}].p > 0 THEN ' detected (' || ev[{p}].p || ' pkts)' ELSE ' detected in raw_protocols' END"


def product(rules) -> str:
    return " * ".join(f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 1 END" for c, v, _ in rules)


def texts(rules) -> str:
    rows = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, _, r in rules)
    return f"list_filter([{rows}], lambda x: x IS NOT NULL)"


USABLE = "NOT list_contains(carriers, p) AND list_contains(present, p)"
FACTORS = lambda hits, weight: f"list_transform({hits}, lambda p: {weight}::DOUBLE * ev[p].f)"
# half up on the shortest decimal form of a number
ROUNDED = "CAST(round(CAST(CAST(score AS VARCHAR) AS DECIMAL(30, 17)), 2) AS DOUBLE)"
DOMAIN_VALUE = f"CASE WHEN d.domain = profile_domain THEN d.score * 3.0::DOUBLE WHEN {family_of('d.domain')} = family THEN d.score * (3.0::DOUBLE * 0.7::DOUBLE) ELSE 0 END"

RANKED = f"""
peers AS (SELECT DISTINCT capture_id, lower(name) AS name FROM mix WHERE name IS NOT NULL UNION SELECT capture_id, lower(role) FROM mix WHERE role IS NOT NULL),
hinted AS (SELECT capture_id, list(DISTINCT w) AS hints FROM peers JOIN (SELECT unnest({items(WORDS)}) AS w) words ON contains(name, w) GROUP BY 1),
held AS (SELECT capture_id, list(DISTINCT lower(role)) AS roles FROM mix WHERE lower(role) IN ('mme', 'hss', 'sgw', 'pgw', 'sbc') GROUP BY 1),
nm AS (SELECT capture_id, bool_or(name LIKE '%3gppnetwork.org%') AS net, bool_or(name LIKE '%pcscf%') AS pcscf FROM mix WHERE name IS NOT NULL GROUP BY 1),
evm AS (SELECT capture_id, map(list(protocol ORDER BY protocol), list({{'p': packets, 'f': factor, 's': source}} ORDER BY protocol)) AS ev, list(protocol) AS present FROM ev GROUP BY 1),
doms AS (SELECT capture_id, list({{'domain': domain, 'score': score}} ORDER BY rank) AS domains FROM domains GROUP BY 1),
cap AS (SELECT evm.*, totals.total, coalesce(domains, []) AS domains, coalesce(hints, []) AS hints, coalesce(roles, []) AS roles, {items(CARRIERS)} AS carriers,
    CASE WHEN net THEN 3 ELSE 0 END AS strong_names, coalesce(pcscf::INT, 0) + CASE WHEN net THEN 1 ELSE 0 END AS supporting_names,
    CASE WHEN net THEN list_concat(['DNS trace matches telecom core naming — APN/realm/core service resolution support traffic', '3gppnetwork.org naming detected',
      'APN/EPC MCC/MNC naming pattern detected', 'MCC/MNC operator naming pattern detected'], CASE WHEN pcscf THEN ['P-CSCF IMS host naming'] ELSE [] END, ['3GPP naming context'])
      ELSE [] END AS naming_reasons,
    domains[1].domain AS top_domain, coalesce(domains[1].score, 0) AS top_score, {family_of('domains[1].domain')} AS top_family,
    list_transform(coalesce(domains, []), lambda d: {family_of('d.domain')}) AS families
  FROM evm JOIN totals USING (capture_id) LEFT JOIN doms USING (capture_id) LEFT JOIN hinted USING (capture_id) LEFT JOIN held USING (capture_id) LEFT JOIN nm USING (capture_id)),
hit AS (SELECT *, list_filter(strong, lambda p: {USABLE}) AS sh, list_filter(triggers, lambda p: {USABLE} AND NOT list_contains(strong, p)) AS th,
    list_filter(weak, lambda p: {USABLE} AND NOT list_contains(strong, p) AND NOT list_contains(triggers, p)) AS wh FROM cap, prof),
sig0 AS (SELECT *, coalesce(list_sum(list_concat({FACTORS('sh', 5)}, {FACTORS('th', 2)}, {FACTORS('wh', 0.5)})), 0) AS signal,
    CASE WHEN naming THEN ['dns'] ELSE list_concat(sh, th, wh) END AS matched FROM hit),
based AS (SELECT *,
    CASE WHEN naming THEN CASE WHEN {has('dns')} THEN 2.5::DOUBLE * ev['dns'].f
        + CASE WHEN strong_names >= 2 THEN 4 WHEN strong_names = 1 THEN 2.5 WHEN supporting_names >= 3 THEN 1.5 WHEN supporting_names >= 1 THEN 0.8 ELSE 0 END::DOUBLE ELSE 0 END
      WHEN signal > 0 THEN signal + CASE WHEN list_contains(relevant, 'sctp') AND {has('sctp')} THEN 0.5 ELSE 0 END::DOUBLE
        + CASE WHEN list_contains(relevant, 'tcp') AND {has('tcp')} THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN list_contains(relevant, 'udp') AND {has('udp')} THEN 0.2 ELSE 0 END::DOUBLE
      ELSE 0 END AS base,
    CASE WHEN naming THEN CASE WHEN {has('dns')} THEN list_concat(naming_reasons, [{said("'dns'")}]) ELSE [] END
      ELSE list_concat(list_transform(sh, lambda p: {said('p')} || ' (strong)'), list_transform(th, lambda p: {said('p')}),
        list_transform(wh, lambda p: 'supporting: ' || {said('p')}),
        CASE WHEN signal > 0 AND list_contains(relevant, 'sctp') AND {has('sctp')} THEN ['sctp transport present'] ELSE [] END) END AS told FROM sig0),
gate AS (SELECT *, CASE WHEN base > 0 THEN base * {product(GATES)} ELSE base END AS gated,
    CASE WHEN base > 0 THEN list_concat(told, {texts(GATES)}) ELSE told END AS gate_told FROM based),
aligned AS (SELECT *, list_max(list_transform(domains, lambda d: {DOMAIN_VALUE})) AS best,
    list_filter(list_transform(domains, lambda d: {{'v': {DOMAIN_VALUE}, 'd': d.domain}}), lambda x: x.v > 0) AS lifts FROM gate),
summed AS (SELECT *, CASE WHEN gated > 0 THEN (gated + coalesce(greatest(best, 0), 0) + {" + ".join(f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0 END" for c, v, _ in BONUSES)})
      * CASE WHEN top_family IS NOT NULL AND top_score >= 0.75 THEN CASE {" ".join(f"WHEN {c} THEN {v}::DOUBLE" for c, v, _ in MISMATCHES)} ELSE 1 END ELSE 1 END ELSE gated END AS scored,
    list_filter(list_concat(gate_told, [CASE WHEN best > 0 THEN 'aligned with suspected domain ' || list_filter(lifts, lambda x: x.v = best)[1].d END], {texts(BONUSES)},
      [CASE WHEN top_family IS NOT NULL AND top_score >= 0.75 THEN CASE {" ".join(f"WHEN {c} THEN {r}" for c, _, r in MISMATCHES)} END END]), lambda x: x IS NOT NULL) AS all_told FROM aligned),
named_best AS (SELECT capture_id, max(CASE WHEN naming AND gated > 0 THEN scored ELSE 0 END) AS naming_score FROM summed GROUP BY 1),
fan AS (SELECT *, naming_score >= 4 AND NOT {has("ngap nas-5gs s1ap nas-eps diameter sip sdp gtpv2 gtpv1 map tcap sccp isup")} AND gated > 0 AND NOT naming
    AND NOT ({named('volte-dns vonr-dns')} AND {IMS}) AS out FROM summed JOIN named_best USING (capture_id)),
ordered AS (SELECT * EXCLUDE (all_told), CASE WHEN out AND profile LIKE '%-dns' THEN scored * 0.3::DOUBLE WHEN out AND {named('lte-core 5g-core lte-sbc-cbc 2g3g-ss7-geran')} THEN scored * 0.35::DOUBLE
      ELSE scored END AS score,
    list_concat(CASE WHEN gated > 0 THEN list_transform(list_sort(list_transform(list_distinct(all_told), lambda r: {{'k': CASE WHEN starts_with(r, 'aligned with suspected domain') THEN 0
        WHEN starts_with(r, 'treated as cross-generation side signal') THEN 1 WHEN starts_with(r, 'voice profile downranked') THEN 2 WHEN contains(r, 'outweighs weak') THEN 3
        WHEN contains(r, 'telecom core naming') OR contains(r, 'telecom core DNS naming') THEN 5 ELSE 10 END, 'r': r}})), lambda s: s.r)
      WHEN len(gate_told) = 0 THEN ['no matching protocol evidence'] ELSE gate_told END,
      CASE WHEN out AND profile LIKE '%-dns' THEN ['downranked: telecom core naming support profile provides the stronger explanation']
        WHEN out AND {named('lte-core 5g-core lte-sbc-cbc 2g3g-ss7-geran')} THEN ['downranked: family-specific profile without signaling anchor in DNS support trace'] ELSE [] END) AS reasons FROM fan),
placed AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, profile) AS rank,
    len(list_filter(list_concat(strong, triggers, weak), lambda p: NOT list_contains(carriers, p) AND ev[p].s = 'count')) AS hits,
    len(list_filter(list_concat(strong, triggers, weak), lambda p: NOT list_contains(carriers, p) AND ev[p].s = 'raw')) AS raw_hits,
    len(list_filter(reasons, lambda r: contains(r, 'resolved peer hints'))) > 0 AS hosts FROM ordered WHERE gated > 0),
graded AS (SELECT *, CASE
    WHEN naming AND NOT {has('dns')} THEN 'low|weak' WHEN naming AND strong_names >= 2 THEN 'high|protocol_strong'
    WHEN naming AND (strong_names = 1 OR supporting_names >= 2) THEN 'medium|protocol_partial' WHEN naming THEN 'low|protocol_partial'
    WHEN {named('lte-s5 lte-s8')} AND coalesce(ev['gtpv2'].p, 0) = 0 AND coalesce(ev['gtp'].p, 0) > 0 THEN CASE WHEN hosts THEN 'low|protocol_partial_with_host_hints' ELSE 'low|protocol_partial' END
    WHEN hits >= 2 THEN CASE WHEN hosts THEN 'high|protocol_strong_with_host_hints' ELSE 'high|protocol_strong' END
    WHEN hits >= 1 AND raw_hits >= 1 AND hosts THEN 'medium|protocol_partial_with_host_hints' WHEN hits >= 1 THEN 'medium|protocol_partial'
    WHEN raw_hits >= 1 THEN CASE WHEN hosts THEN 'low|protocol_partial_with_host_hints' ELSE 'low|raw_protocol_partial' END
    ELSE CASE WHEN hosts THEN 'low|host_hints_only' ELSE 'low|weak' END END AS grade FROM placed)"""

RANK = f"""SELECT capture_id, rank, profile, {ROUNDED} AS score, array_to_string(reasons[1:5], '; ') AS reasons, split_part(grade, '|', 1) AS confidence,
  split_part(grade, '|', 2) AS evidence_class, family, profile_domain, interface FROM graded WHERE rank <= 8"""
SUPPRESSED = """SELECT * FROM (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY score, profile) AS rank, profile, round(score, 2) AS score,
  array_to_string(reasons[1:3], '; ') AS reasons FROM ordered WHERE NOT gated > 0) WHERE rank <= 8"""
BEST = "SELECT cap.capture_id, coalesce(profile, 'lte-core') AS profile FROM cap LEFT JOIN graded ON graded.capture_id = cap.capture_id AND rank = 1"

MODERN, OLD, CONTROL = "ngap nas-5gs s1ap nas-eps http", "bssap dtap gsm_a isup map tcap", "ngap s1ap diameter sip map gtpv2"
ENRICHED = f"""
counted AS (SELECT capture_id, list(name) AS shown, max(n) FILTER (WHERE name = 'diameter') AS diameters, max(n) FILTER (WHERE name = 'dns') AS dnses,
    max(n) FILTER (WHERE name = 'http') AS https, max(n) FILTER (WHERE name = 'json') AS jsons FROM pc GROUP BY 1),
sigs AS (SELECT capture_id, list(protocol) AS sigs FROM sig GROUP BY 1),
carried AS (SELECT capture_id, coalesce(max(n) FILTER (WHERE name = 'sctp'), 0) AS sctps FROM tc GROUP BY 1),
cand AS (SELECT capture_id, list({{'rank': rank, 'profile': profile, 'reasons': reasons[1:5], 'confidence': split_part(grade, '|', 1), 'evidence': split_part(grade, '|', 2)}} ORDER BY rank) AS cands
  FROM graded WHERE rank <= 6 GROUP BY 1),
met AS (SELECT shape.capture_id, split_part(s, '|', 1) AS trace_shape, counted AS packets, signalling, raws.signals, shown, coalesce(diameters, 0) AS diameters, coalesce(dnses, 0) AS dnses,
    coalesce(https, 0) AS https, coalesce(jsons, 0) AS jsons, coalesce(cands, []) AS cands0, coalesce(doms.domains, []) AS domains, sigs, sctps, totals.total
  FROM shape JOIN counted USING (capture_id) JOIN sigs USING (capture_id) JOIN carried USING (capture_id) JOIN totals USING (capture_id)
  LEFT JOIN raws USING (capture_id) LEFT JOIN doms USING (capture_id) LEFT JOIN cand USING (capture_id)),
cleared AS (SELECT *, coalesce(trace_shape = 'single_domain' AND domains[1].domain = 'lte-eps' AND domains[1].score >= 0.7 AND cands0[1].profile = 'lte-s6a'
      AND list_has_all(sigs, ['diameter', 'sctp']), false) AS s6a,
    list_transform(cands0, lambda c: starts_with(c.profile, 'volte-') AND len(list_filter(c.reasons, lambda r: contains(r, 'downranked') AND contains(r, 'IMS'))) > 0) AS down FROM met),
refined AS (SELECT *, CASE WHEN s6a THEN list_transform(cands0, lambda c, i: CASE WHEN down[i] THEN 'low|downranked_protocol_match' ELSE c.confidence || '|' || c.evidence END)
    ELSE list_transform(cands0, lambda c: c.confidence || '|' || c.evidence) END AS grades FROM cleared),
noted AS (SELECT *, list_filter([
    CASE WHEN signalling = 0 AND signals IS NULL THEN 'transport-only trace: no application or signaling protocol decoded' END,
    CASE WHEN trace_shape = 'transport_only' AND sctps > 0 AND signalling = 0 THEN
      'SCTP flows present but no upper-layer protocol decoded — check port assignments or try --tshark-arg ''-d sctp.port==<port>,<dissector>''' END,
    CASE WHEN diameters > 0 AND diameters / greatest(packets, 1) < 0.03 THEN 'diameter present but sparse — may need ''--tshark-arg "-d sctp.port==3868,diameter"''' END,
    CASE WHEN https > 0 AND jsons = 0 THEN 'HTTP/2 detected without JSON body visibility — SBI payload content may not be decoded' END,
    CASE WHEN trace_shape = 'mixed_domain' THEN 'mixed-domain trace — consider running discover for profile selection' END,
    CASE WHEN list_has_any(shown, {items(MODERN)}) AND list_has_any(shown, {items(OLD)}) THEN 'legacy protocol(s) present alongside modern signaling: '
      || array_to_string(list_filter({items(OLD)}, lambda p: list_contains(shown, p)), ', ') || ' — may indicate interworking trace or stray frames' END], lambda x: x IS NOT NULL) AS anomalies,
  list_filter([
    CASE WHEN signalling = 0 AND signals IS NOT NULL THEN 'decoded top protocols are coarse; discovery is relying on raw signaling hints for classification' END,
    CASE WHEN dnses > 0 AND NOT list_has_any(shown, {items(CONTROL)}) THEN 'DNS-only trace with no control-plane signaling — may be a support-traffic-only capture' END,
    CASE WHEN dnses > 0 AND NOT list_has_any(shown, {items(CONTROL)}) THEN 'family assignment remains ambiguous — DNS-only without domain-specific service markers' END,
    CASE WHEN len(list_filter(grades[1:4], lambda g: split_part(g, '|', 2) IN ('host_hints_only', 'protocol_partial_with_host_hints'))) > 0
      THEN 'low-confidence specialization due to host hints; treat interface naming as plausible rather than fully proven' END,
    CASE WHEN s6a AND list_contains(down, true) THEN 'downranked IMS Diameter candidates remain visible as generic Diameter/SCTP overlaps, not as strong IMS matches' END],
    lambda x: x IS NOT NULL) AS notes FROM refined)"""
ENRICHMENT = """SELECT capture_id, trace_shape, CASE WHEN trace_shape = 'transport_only' THEN 'unknown' WHEN trace_shape = 'mixed_domain' THEN 'mixed'
    WHEN len(list_filter(notes, lambda n: contains(n, 'DNS') OR contains(n, 'dns') OR contains(n, 'ambiguous'))) > 0 OR (len(domains) = 1 AND domains[1].domain = 'dns-support') THEN 'ambiguous_support'
    WHEN len(list_filter(notes, lambda n: contains(lower(n), 'host hint') OR contains(lower(n), 'partial'))) > 0
      OR (len(grades) > 0 AND len(list_filter(grades[1:3], lambda g: split_part(g, '|', 1) <> 'low')) = 0) THEN 'partial'
    WHEN len(domains) > 0 AND domains[1].score >= 0.7 THEN 'confident' WHEN len(domains) > 0 THEN 'partial' ELSE 'unknown' END AS classification_state,
  array_to_string(anomalies, '; ') AS network_anomalies, array_to_string(notes, '; ') AS classification_notes, array_to_string(list_filter([
    CASE WHEN trace_shape = 'transport_only' THEN 'run discover to see if a protocol dissector override is needed' END,
    CASE WHEN trace_shape <> 'transport_only' AND len(domains) = 0 THEN 'no strong domain detected — run discover for broad protocol inventory' END,
    CASE WHEN known AND trace_shape = 'single_domain' AND len(cands0) > 0 THEN 'run: analyze <capture> --profile ' || cands0[1].profile END,
    CASE WHEN known AND trace_shape = 'mixed_domain' THEN 'mixed domains detected — run discover to see full candidate profile list' END,
    CASE WHEN known AND trace_shape = 'mixed_domain' AND len(cands0) > 0 THEN 'or run separate analyze passes per domain, starting with: --profile ' || cands0[1].profile END,
    CASE WHEN known AND total > 5000 AND s6a THEN 'large capture — narrow first with `-Y "diameter && sctp"` before full S6a analyze' END,
    CASE WHEN known AND total > 5000 AND NOT s6a THEN 'large capture — consider narrowing with -Y display filter before full analyze' END,
    CASE WHEN known AND NOT s6a THEN CASE domains[1].domain
      WHEN '5g-sa-core' THEN '5G SA Core signals detected — try profiles: 5g-n2, 5g-n1-n2, 5g-nas-5gs, 5g-sbi'
      WHEN '5g-sa-core-sbi' THEN '5G SA Core signals detected — try profiles: 5g-n2, 5g-n1-n2, 5g-nas-5gs, 5g-sbi'
      WHEN 'lte-eps' THEN 'LTE/EPS signals detected — try profiles: lte-s1, lte-s1-nas, lte-s6a, lte-s11'
      WHEN 'ims-voice' THEN 'IMS/Voice signals detected — try profiles: volte-sip, volte-ims-core, vonr-sip'
      WHEN 'legacy-2g3g' THEN '2G/3G core signals detected — try profiles: 2g3g-map-core, 2g3g-geran, 2g3g-gn' END END], lambda x: x IS NOT NULL), '; ') AS next_step_hints
FROM (SELECT *, trace_shape <> 'transport_only' AND len(domains) > 0 AS known FROM noted)"""
