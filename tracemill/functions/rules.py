"""Fixed values of domain inference and profile ranking: protocol sets, weights, combinations, hints."""

from __future__ import annotations

from tracemill.functions.tables import _named

# Protocols that alone say nothing about the network domain.
TRANSPORT_PROTOCOLS = """
ip ipv6 tcp udp sctp eth ethertype vlan frame data arp ppp pppoe pppoed pppoes lcp ipcp pap chap
wlan wlan_radio radiotap ieee80211 llc sll null loop
""".split()
# Protocol roles.
SIGNALING_PROTOCOLS = """
ngap nas-5gs nr-rrc http json pfcp s1ap nas-eps diameter gtpv2 gtpv1 sip sdp rtp rtcp dns
map tcap sccp mtp3 m3ua bssap bssmap dtap isup cap sbcap
""".split()
SUPPORT_TRANSPORTS = "sctp tcp udp".split()
LINK_PROTOCOLS = """
eth ethertype vlan frame data ip ipv6 ip.options ipv6.hopopts arp ppp pppoe pppoed pppoes lcp ipcp pap chap
wlan wlan_radio radiotap ieee80211 llc sll null loop
""".split()
# Protocol -> spellings that count for it, in ranking and in signalling.
RANKING_VARIANTS = _named("""
bssap: bssap gsm_a.bssap
bssap+: bssap+ bssap gsm_a.bssap
bssmap: bssmap gsm_a.bssmap
dtap: dtap gsm_a.dtap gsm_dtap
http: http http2
map: map gsm_map
mtp3: mtp3 mtp3mg
nas-eps: nas-eps nas_eps
nas-5gs: nas-5gs nas_5gs
ss7: ss7 m3ua m2pa mtp
""")
SIGNALING_VARIANTS = {k: v for k, v in RANKING_VARIANTS.items() if k != "bssap+"}
# Evidence factors and thresholds.
FREQUENCY_STEPS = [(0.005, 0.2), (0.01, 0.4), (0.05, 0.7)]
RAW_FACTOR, RAW_TRANSPORT_FACTOR = 0.85, 0.35
DOMINANT_THRESHOLD, DOMAIN_THRESHOLD = 0.5, 0.35
# Priority of signalling protocols, and protocols that a domain expects.
SIGNAL_PRIORITY = {
    "ngap": 120, "nas-5gs": 115, "http": 105, "json": 100, "pfcp": 98, "s1ap": 96, "sip": 94, "sdp": 92, "dns": 90,
    "nas-eps": 88, "diameter": 86, "gtpv2": 84, "gtpv1": 78, "map": 76, "tcap": 74, "sccp": 72, "mtp3": 70,
    "bssap": 68, "dtap": 64, "isup": 60,
}
DOMAIN_PROTOCOLS = _named("""
5g-sa-core: ngap nas-5gs http json pfcp dns
5g-sa-core-sbi: http json pfcp dns
lte-eps: s1ap nas-eps diameter gtpv2 dns
ims-voice: sip sdp dns rtp rtcp
legacy-2g3g: map tcap sccp mtp3 bssap dtap isup cap
legacy-2g3g-gprs: gtpv1 dns
""")
DOMAIN_FAMILY = {
    "5g-sa-core": "5g", "5g-sa-core-sbi": "5g", "lte-eps": "lte", "ims-voice": "voice",
    "legacy-2g3g": "2g3g", "legacy-2g3g-gprs": "2g3g",
}
# Protocol combinations -> domain, score, summary; the first of equal scores wins.
DOMAIN_COMBOS = [
    ("ngap nas-5gs sctp", "5g-sa-core", 0.95, "ngap + nas-5gs + sctp = strong 5G N1/N2 signal"),
    ("ngap nas-5gs", "5g-sa-core", 0.88, "ngap + nas-5gs = 5G N1/N2 control-plane"),
    ("ngap sctp", "5g-sa-core", 0.80, "ngap + sctp = 5G N2 interface"),
    ("ngap", "5g-sa-core", 0.55, "ngap detected"),
    ("nas-5gs", "5g-sa-core", 0.45, "nas-5gs detected"),
    ("http json", "5g-sa-core-sbi", 0.65, "http + json = 5G SBI interface"),
    ("http", "5g-sa-core-sbi", 0.40, "http detected (possible SBI)"),
    ("s1ap nas-eps sctp", "lte-eps", 0.95, "s1ap + nas-eps + sctp = strong LTE S1 signal"),
    ("s1ap nas-eps", "lte-eps", 0.88, "s1ap + nas-eps = LTE S1/NAS"),
    ("s1ap sctp", "lte-eps", 0.80, "s1ap + sctp = LTE S1 interface"),
    ("s1ap", "lte-eps", 0.55, "s1ap detected"),
    ("diameter sctp", "lte-eps", 0.72, "diameter + sctp = Diameter over SCTP (S6a / Cx / Rx)"),
    ("diameter", "lte-eps", 0.50, "diameter detected"),
    ("gtpv2 udp", "lte-eps", 0.70, "gtpv2 + udp = GTPv2-C (S11 / S5 / S8)"),
    ("gtpv2", "lte-eps", 0.55, "gtpv2 detected"),
    ("sip sdp", "ims-voice", 0.90, "sip + sdp = active call flow"),
    ("sip dns", "ims-voice", 0.72, "sip + dns = IMS registration or discovery"),
    ("sip", "ims-voice", 0.55, "sip detected"),
    ("bssap dtap sccp", "legacy-2g3g", 0.88, "bssap + dtap + sccp = strong GERAN/A-interface signal"),
    ("bssap dtap mtp3", "legacy-2g3g", 0.88, "bssap + dtap + mtp3 = strong GERAN/A-interface signal"),
    ("bssap dtap ss7", "legacy-2g3g", 0.84, "bssap + dtap + ss7 = strong GERAN/A-interface signal"),
    ("map tcap sccp", "legacy-2g3g", 0.92, "map + tcap + sccp = SS7/MAP core"),
    ("sccp tcap mtp3", "legacy-2g3g", 0.84, "sccp + tcap + mtp3 = legacy SS7 control plane"),
    ("sccp tcap ss7", "legacy-2g3g", 0.82, "sccp + tcap + ss7 = legacy SS7 control plane"),
    ("sccp mtp3", "legacy-2g3g", 0.52, "sccp + mtp3 = legacy SS7 transport/signaling"),
    ("gtpv1 udp", "legacy-2g3g-gprs", 0.70, "gtpv1 + udp = 2G/3G GPRS Gn/Gp"),
    ("dns", "dns-support", 0.40, "dns detected"),
]
# Plain gtp stands for GTPv1 when no other GTP version is there.
GTP_FALLBACK = (
    "legacy-2g3g-gprs", 0.65,
    "gtp (GTPv1) + udp = legacy GTPv1 packet-core (Gn/Gp ambiguous — no GTPv2 control plane detected)",
)
# Protocol sets of the ranking rules.
LEGACY_PARTNERS = "bssap bssmap sccp mtp3 ss7 map tcap cap gtpv1".split()
STRONG_LEGACY_COMBOS = [
    "bssap dtap sccp", "bssap dtap mtp3", "bssap dtap ss7", "map tcap sccp", "sccp tcap mtp3", "sccp tcap ss7", "gtpv1 udp",
]
VOICE_SIGNALS = "sip sdp rtp rtcp".split()
CALL_PROTOCOLS = "sdp rtp rtcp".split()
LTE_ANCHORS = "s1ap diameter gtpv2".split()
FANOUT_ANCHORS = "ngap nas-5gs s1ap nas-eps diameter sip sdp gtpv2 gtpv1 map tcap sccp isup".split()
# Profile sets of the ranking rules.
HYBRID_VOICE = "vonr-n1-n2-voice vonr-ims-core".split()
IMS_DIAMETER = "volte-diameter-cx volte-diameter-rx volte-diameter-sh volte-ims-core".split()
IMS_CORE = "volte-ims-core vonr-ims-core".split()
VOICE_SIP = """
volte-sbc volte-sip volte-sip-call volte-sip-register vonr-sbc vonr-sip vonr-sip-call vonr-sip-register
""".split()
VOICE_DNS = "volte-dns vonr-dns".split()
GENERIC_SBI = "5g-sbi 5g-core".split()
FANOUT_CORE = "lte-core 5g-core lte-sbc-cbc 2g3g-ss7-geran".split()
# Words in peer names that hint at a role or interface.
HINTS = _named("""
register: pcscf scscf icscf registrar register auth aka hss
sbc: sbc ibcf ebcf session-border border-controller
ims: ims cscf pcscf scscf icscf sbc tas bgcf as mmtel
s6a: s6a mme hss
s5s8: s5 s8 s5-s8 pgw sgw spgw roaming
s10: s10 inter-mme relocation
s11: s11 mme sgw
n26: n26 interworking amf mme
dns5g: amf smf pcf udm ausf nrf ngap n2 5g
dnslte: mme sgw pgw hss enb lte s1 s6 s11
sbi: amf smf pcf udm ausf nrf nssf scp
""")
SBI_HINTS = _named("""
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
""")
# Patterns of telecom names, strong and supporting, with the reason they give.
STRONG_NAMES = [
    ("3gppnetwork.org", "3gppnetwork.org naming detected"),
    (".gprs", ".gprs operator domain detected"),
    ("epc.mnc", "APN/EPC MCC/MNC naming pattern detected"),
    ("ims.mnc", "IMS MCC/MNC naming pattern detected"),
    ("5gc.mnc", "5GC MCC/MNC naming pattern detected"),
    ("apn.epc", "APN resolution naming detected"),
    ("topon.", "TOPON DNS routing prefix detected (3GPP node resolution)"),
    (None, "MCC/MNC operator naming pattern detected"),
]
OPERATOR_PATTERN = "mnc[0-9]{2,3}[.]mcc[0-9]{3}"
SUPPORTING_NAMES = [
    ("pcscf", "P-CSCF IMS host naming"),
    ("scscf", "S-CSCF IMS host naming"),
    ("icscf", "I-CSCF IMS host naming"),
    ("mmtel", "MMTel IMS service naming"),
    ("nrf.", "5G NRF service naming"),
    ("amf.", "5G AMF naming"),
    ("smf.", "5G SMF naming"),
    ("udm.", "5G UDM naming"),
    ("ausf.", "5G AUSF naming"),
    ("nssf.", "5G NSSF naming"),
    ("3gpp", "3GPP naming context"),
    ("pgw.", "P-GW node naming"),
    ("sgw.", "S-GW node naming"),
    ("mme.", "MME node naming"),
    ("hss.", "HSS node naming"),
    ("enb.", "eNodeB naming"),
    ("gnb.", "gNodeB naming"),
]
NAMING_SUMMARY_STRONG = "DNS trace matches telecom core naming — APN/realm/core service resolution support traffic"
NAMING_SUMMARY_WEAK = "DNS naming context suggests telecom core support traffic"


def all_hint_words() -> list[str]:
    words = [w for group in (*HINTS.values(), *SBI_HINTS.values()) for w in group]
    return list(dict.fromkeys(words))
