"""Rule profiles: which protocols matter, in which order, and which fields are kept.

A profile is a small dimension held on the driver; expressions are generated from it.  The built-in ones state protocols,
priorities, aliases, verbatim layers and transport fields.  Their field whitelists follow a rule: every signalling protocol keeps all fields
named after its layers, wherever they lie, and the few fields of other layers that are listed here.  Shorter lists are a parameter (``builtin_profiles``).
"""

from __future__ import annotations

import pathlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from tracemill.functions import tables

# Profile, relevant protocols, protocol priority ("=" repeats the relevant ones).
CATALOGUE = """
2g3g-bssap | bssap bssmap dtap sccp mtp3 | = ip
2g3g-cap | cap tcap sccp mtp3 | = ip
2g3g-dns | dns tcp udp ip | =
2g3g-geran | bssap dtap gsm_a sccp mtp3 | = ip
2g3g-gn | gtpv1 gtp icmp udp ip | =
2g3g-gp | gtpv1 gtp udp ip | =
2g3g-gr | map tcap sccp mtp3 ss7 | = ip
2g3g-gs | bssap+ dtap sccp mtp3 ss7 | = ip
2g3g-isup | isup mtp3 ss7 | = ip
2g3g-map-core | map tcap sccp mtp3 | = ip
2g3g-sccp-mtp | sccp mtp3 ss7 | = ip
2g3g-ss7-geran | map cap isup bssap gsm_a.dtap tcap sccp m3ua dns | = sctp tcp udp ip
5g-cbc-cbs | sbcap sctp ip | =
5g-core | pfcp ngap nas-5gs http dns tls | = sctp tcp udp ip
5g-dns | dns tcp udp ip | =
5g-n1-n2 | ngap nas-5gs sctp | = ip
5g-n10 | http json tcp ip | =
5g-n11 | http json tcp ip | =
5g-n12 | http json tcp ip | =
5g-n13 | http json tcp ip | =
5g-n14 | http json tcp ip | =
5g-n15 | http json tcp ip | =
5g-n16 | http json tcp ip | =
5g-n2 | ngap sctp ip | =
5g-n22 | http json tcp ip | =
5g-n26 | gtpv2 http json udp tcp ip | =
5g-n40 | http json tcp ip | =
5g-n8 | http json tcp ip | =
5g-nas-5gs | nas-5gs ngap sctp | = ip
5g-sbi | http json tcp ip | =
5g-sbi-auth | http json tcp ip | =
core-name-resolution | dns udp tcp ip | =
lte-core | diameter gtpv2 s1ap nas-eps dns tls http | = sctp tcp udp ip
lte-dns | dns tcp udp ip | =
lte-s1 | s1ap nas-eps sctp | = ip
lte-s1-nas | nas-eps s1ap sctp | = ip
lte-s10 | gtpv2 udp ip | =
lte-s11 | gtpv2 udp ip | =
lte-s5 | gtpv2 gtp udp ip | =
lte-s6a | diameter sctp | = ip
lte-s8 | gtpv2 gtp udp ip | =
lte-sbc-cbc | sbcap sctp ip | =
lte-sgs | sgsap sctp ip | =
transport-core | tcp udp sctp ip ipv6 icmp | sctp tcp udp icmp ip ipv6
transport-sctp | sctp ip ipv6 | =
transport-tcp | tcp ip ipv6 tls | tcp tls ip ipv6
transport-udp | udp ip ipv6 icmp dns | udp dns icmp ip ipv6
volte-diameter-cx | diameter sctp tcp ip | =
volte-diameter-rx | diameter sctp tcp ip | =
volte-diameter-sh | diameter sctp tcp ip | =
volte-dns | dns udp tcp ip | =
volte-ims-core | sip diameter dns tcp udp sctp ip | sip diameter dns sctp tcp udp ip
volte-rtp-signaling | sip sdp rtp rtcp udp ip | =
volte-sbc | sip dns tcp udp ip | =
volte-sip | sip dns tcp udp ip | =
volte-sip-call | sip dns tcp udp ip | =
volte-sip-register | sip dns tcp udp ip | =
vonr-dns | dns udp tcp ip | =
vonr-ims-core | sip http json dns ngap nas-5gs tcp udp sctp ip | sip http ngap nas-5gs json dns sctp tcp udp ip
vonr-n1-n2-voice | ngap nas-5gs sctp ip | =
vonr-policy | http json tcp ip | =
vonr-sbc | sip dns tcp udp ip | =
vonr-sbi-auth | http json tcp ip | =
vonr-sbi-pdu | http json tcp ip | =
vonr-sip | sip dns tcp udp ip | =
vonr-sip-call | sip dns tcp udp ip | =
vonr-sip-register | sip dns tcp udp ip | =
"""
# Protocol -> layer names that count as it (all others only themselves).
ALIASES = """
bssap+: bssap+ bssap
bssmap: bssap bssmap
cap: camel cap
dtap: gsm_a.dtap gsm_dtap dtap
gsm_a.dtap: gsm_a.dtap gsm_dtap dtap
gtpv1: gtp gtpv1
gtpv2: gtpv2 gtpv2-c
http: http2 http
icmp: icmp icmpv6
ip: ip ipv6
map: gsm_map map
mtp3: mtp3 mtp3mg
nas-5gs: nas-5gs nas_5gs
nas-eps: nas-eps nas_eps
ss7: mtp ss7
tls: tls ssl
"""
# Profiles that read the alias of a protocol differently.
PROFILE_ALIASES = {
    "lte-core": {"gtpv2": ["gtpv2", "gtpv2-c", "gtp"], "http": ["http", "http2"]},
    "transport-core": {"ip": ["ip"]},
    "transport-sctp": {"ip": ["ip"]},
    "transport-tcp": {"ip": ["ip"]},
    "transport-udp": {"ip": ["ip"]},
}
# Profiles that keep a layer verbatim.
PROFILE_VERBATIM = {
    "lte-s6a": ["diameter"],
    "transport-core": ["tcp", "udp", "sctp"],
    "transport-sctp": ["sctp"],
    "transport-tcp": ["tcp"],
    "transport-udp": ["udp"],
    "volte-diameter-cx": ["diameter"],
    "volte-diameter-rx": ["diameter"],
    "volte-diameter-sh": ["diameter"],
    "volte-ims-core": ["diameter"],
}
# Profiles whose reduced transport keeps the SCTP stream.
KEEP_SCTP_STREAM = """
2g3g-ss7-geran 5g-cbc-cbs 5g-core 5g-n1-n2 5g-n2 5g-nas-5gs lte-core lte-s1 lte-s1-nas lte-s6a lte-sbc-cbc lte-sgs
transport-core transport-sctp volte-diameter-cx volte-diameter-rx volte-diameter-sh volte-ims-core vonr-ims-core vonr-n1-n2-voice
""".split()
# Protocols whose messages keep no fields from outside their layer.
CARRIERS = "tcp udp sctp ip ipv6 tls ss7".split()
# Protocol -> fields of other layers that its messages keep.
FOREIGN_FIELDS = """
bssap: gsm_a.imsi e212.imsi e164.msisdn gsm_a.rr.cause gsm_a.rr.RR_cause
bssap+: gsm_a.rr.cause gsm_a.rr.RR_cause
cap: e212.imsi e164.msisdn
dtap: gsm_a.imsi
gsm_a: e212.imsi e164.msisdn
gsm_a.dtap: gsm_a.imsi e212.imsi e164.msisdn
isup: e164.called_party_number.digits e164.calling_party_number.digits
map: e212.imsi e164.msisdn
"""
# Name start -> (family, domain) where a profile does not state its own.
FAMILY_BY_PREFIX = {
    "lte-": ("lte", "eps"),
    "5g-": ("5g", "5g-sa-core"),
    "volte-": ("voice", "volte-eps"),
    "vonr-": ("voice", "vonr-5gs"),
    "2g3g-": ("2g3g", "legacy-core"),
}
# Protocols that a discovery profile always covers.
DISCOVERY_FALLBACK = "sip diameter gtpv2 ngap nas-5gs http json dns map cap isup sctp tcp udp ip".split()
NAMING_PROFILE = "core-name-resolution"


@dataclass
class Profile:
    name: str
    relevant: list[str]
    priority: list[str]
    aliases: dict[str, list[str]] = field(default_factory=dict)
    fields: dict[str, list[str]] = field(default_factory=dict)
    verbatim: list[str] = field(default_factory=list)
    keep_raw_avps: bool = False
    transport_fields: list[str] = field(default_factory=lambda: list(tables.REDUCED_TRANSPORT_FIELDS))
    max_conversations: int = tables.CONVERSATIONS_KEPT
    selector: dict | None = None

    def layer_names(self, protocol: str) -> list[str]:
        return self.aliases.get(protocol, [protocol])

    def selector_row(self) -> dict:
        """Family, domain, interface and indicator lists; inferred from the name unless stated."""
        if self.selector:
            stated = self.selector
            return {
                "family": stated["family"],
                "domain": stated["domain"],
                "interface": stated.get("interface"),
                "strong": list(stated.get("strong_indicators", [])),
                "triggers": list(stated.get("triggers", {}).get("protocols", [])),
                "weak": list(stated.get("weak_indicators", [])),
            }
        prefix = next((p for p in FAMILY_BY_PREFIX if self.name.startswith(p)), None)
        family, domain = FAMILY_BY_PREFIX.get(prefix, ("generic", "mixed"))
        return {
            "family": family,
            "domain": domain,
            "interface": self.name[len(prefix):] if prefix else None,
            "strong": self.priority[:2],
            "triggers": sorted(set(self.relevant)),
            "weak": self.relevant[2:4],
        }


def _alias_table() -> dict[str, list[str]]:
    return tables._named(ALIASES)


def default_fields(protocol: str, layers: list[str]) -> list[str]:
    """Names that messages of a protocol keep besides their layer; ``x.*`` stands for all names that start with ``x.``."""
    if protocol in CARRIERS:
        return []
    return [f"{layer}.*" for layer in layers] + tables._named(FOREIGN_FIELDS).get(protocol, [])


def builtin_profiles(fields: dict[str, dict[str, list[str]]] | None = None) -> dict[str, Profile]:
    """All built-in profiles by name; ``fields`` replaces whitelists: profile name -> protocol -> field names (``x.*``: all that start with ``x.``).

    What ``fields`` does not name follows ``default_fields``.  A folder of rule files holds such lists: ``{p.name: p.fields for p in read_profiles(folder).values()}``.
    """
    aliases = _alias_table()
    found: dict[str, Profile] = {}
    for line in CATALOGUE.strip().splitlines():
        name, relevant_text, priority_text = (part.strip() for part in line.split("|"))
        relevant = relevant_text.split()
        priority = [p for word in priority_text.split() for p in (relevant if word == "=" else [word])]
        own = {p: aliases[p] for p in dict.fromkeys(relevant + priority) if p in aliases}
        own.update(PROFILE_ALIASES.get(name, {}))
        carried = [f for f in tables.REDUCED_TRANSPORT_FIELDS if f != "sctp_stream" or name in KEEP_SCTP_STREAM]
        lists = {p: default_fields(p, own.get(p, [p])) for p in priority} | (fields or {}).get(name, {})
        found[name] = Profile(
            name, relevant, priority, own, lists, PROFILE_VERBATIM.get(name, []), transport_fields=carried
        )
    found[NAMING_PROFILE].selector = {
        "family": "cross-family",
        "domain": "core-support",
        "interface": "name-resolution",
        "strong_indicators": ["dns"],
        "weak_indicators": ["udp", "tcp"],
        "triggers": {"protocols": ["dns", "udp", "tcp"]},
    }
    return found


def profile_from_mapping(data: dict, name: str | None = None) -> Profile:
    """A profile from the keys of a rule file."""
    return Profile(
        name=data.get("name") or name,
        relevant=list(data["relevant_protocols"]),
        priority=list(data["top_protocol_priority"]),
        aliases=dict(data.get("protocol_aliases") or {}),
        fields=dict(data.get("full_detail_fields") or {}),
        verbatim=list(data.get("verbatim_protocols") or []),
        keep_raw_avps=bool(data.get("keep_raw_avps", False)),
        transport_fields=list(data.get("reduced_transport_fields") or []),
        max_conversations=int(data.get("max_conversations", tables.CONVERSATIONS_KEPT)),
        selector=data.get("selector_metadata"),
    )


def load_mapping(path: str) -> dict:
    """One small YAML or JSON settings file, read on the driver."""
    import json

    text = pathlib.Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def read_profiles(folder: str) -> dict[str, Profile]:
    """All rule files of a folder, by name."""
    paths = sorted(p for p in pathlib.Path(folder).iterdir() if p.suffix in {".yaml", ".yml", ".json"})
    found = [profile_from_mapping(load_mapping(str(p)), p.stem) for p in paths]
    return {p.name: p for p in found}


def read_privacy_profile(path: str) -> dict[str, str]:
    return dict(load_mapping(path)["modes"])


def privacy_modes(name_or_path: str) -> dict[str, str]:
    """Modes of a built-in privacy profile, or of a file."""
    modes = tables.PRIVACY_PROFILES.get(name_or_path)
    return dict(modes) if modes else read_privacy_profile(name_or_path)


def discovery_profile(profiles: Iterable[Profile]) -> Profile:
    """Union of all profiles, in order of first mention, plus the fallback protocols."""
    relevant: dict[str, None] = {}
    priority: dict[str, None] = {}
    aliases: dict[str, dict[str, None]] = {}
    for profile in sorted(profiles, key=lambda p: p.name):
        relevant.update(dict.fromkeys(profile.relevant))
        priority.update(dict.fromkeys(profile.priority))
        for protocol in dict.fromkeys(profile.relevant + profile.priority):
            aliases.setdefault(protocol, {}).update(dict.fromkeys(profile.layer_names(protocol)))
    relevant.update(dict.fromkeys(DISCOVERY_FALLBACK))
    priority.update(dict.fromkeys(DISCOVERY_FALLBACK))
    return Profile(
        "discovery",
        list(relevant),
        list(priority),
        {protocol: list(names) for protocol, names in aliases.items()},
        max_conversations=tables.DISCOVERY_CONVERSATIONS_KEPT,
    )


PROFILE_SCHEMA = (
    "profile string, family string, domain string, interface string, relevant array<string>,"
    " strong array<string>, triggers array<string>, weak array<string>"
)


def profile_rows(profiles: Iterable[Profile]) -> list[dict]:
    """One plain row per profile, in name order."""
    return [
        {"profile": p.name, "relevant": p.relevant, **p.selector_row()}
        for p in sorted(profiles, key=lambda p: p.name)
    ]

