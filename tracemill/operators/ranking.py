"""Ranking of rule profiles per capture.

Every capture meets every profile through an array literal, a fixed number of rows per capture.
Gates, bonuses and penalties are tables of (condition, value, reason) in SQL; a row collects those
that hold and folds their values in table order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import rules
from tracemill.functions.sqltext import select_once
from tracemill.operators.domains import TRANSPORT, protocol_reason
from tracemill.operators.evidence import sql_list
from tracemill.sources.profiles import NAMING_PROFILE, PROFILE_SCHEMA, Profile, profile_rows

NO_MATCH = "no matching protocol evidence"


# ------------------------------------------------------------------ conditions
def has(*protocols: str) -> str:
    """Any of the protocols is present."""
    return f"arrays_overlap(present, {sql_list(protocols)})"


def has_all(*protocols: str) -> str:
    return f"size(array_except({sql_list(protocols)}, present)) = 0"


def hint(words: Iterable[str]) -> str:
    """Any of the words occurs in a peer name."""
    return f"arrays_overlap(hints, {sql_list(list(words))})"


def named(*profiles: str) -> str:
    return f"profile in ({', '.join(repr(p) for p in profiles)})"


def roles(*wanted: str) -> str:
    return f"size(array_except({sql_list(wanted)}, roles)) = 0"


IMS_HINT = hint(rules.HINTS["ims"])
VOICE = has(*rules.VOICE_SIGNALS)
CALL = has(*rules.CALL_PROTOCOLS)
REGISTER = f"({hint(rules.HINTS['register'])} or ({IMS_HINT} and {has('diameter', 'dns')}))"
SBC = f"(array_contains(roles, 'sbc') or {hint(rules.HINTS['sbc'])})"
DTAP_COUNT = "coalesce(ev['dtap'].packets, 0)"
STRONG_LEGACY = "(" + " or ".join(has_all(*combo.split()) for combo in rules.STRONG_LEGACY_COMBOS) + ")"
DTAP_MATCHED = "array_contains(matched, 'dtap')"
BSSAP = has("bssap", "bssap+", "bssmap")
GERAN = has("bssap", "bssap+", "bssmap", "dtap", "gsm_a")
GTP1 = has("gtpv1", "gtp")
GTP2 = has("gtpv2")
INTERWORKING = f"(({GTP2} and {has('http', 'json', 'ngap', 'nas-5gs')}) or {hint(rules.HINTS['n26'])})"
EPS_ONLY = f"({GTP2} and not {has('ngap', 'nas-5gs')})"
SPECIFIC_SBI = (
    f"not {named(*rules.GENERIC_SBI, '5g-n26')} and size(array_except(array('http', 'json'), relevant)) = 0"
)
SBI_HINT = (
    "case profile "
    + " ".join(f"when '{p}' then {hint(words)}" for p, words in rules.SBI_HINTS.items())
    + f" else {hint(rules.HINTS['sbi'])} end"
)
ANY_SBI_HINT = hint(dict.fromkeys(w for words in rules.SBI_HINTS.values() for w in words))
IMS_MISSING = f"not ({VOICE} or {IMS_HINT})"
both_ims = [p for p in rules.IMS_DIAMETER if p in rules.IMS_CORE]
only_diameter = [p for p in rules.IMS_DIAMETER if p not in rules.IMS_CORE]
only_core = [p for p in rules.IMS_CORE if p not in rules.IMS_DIAMETER]

# (condition, factor, reason), applied in this order
GATES = [
    (f"family = '2g3g' and {DTAP_MATCHED} and not {has(*rules.LEGACY_PARTNERS)}", 0.12, "DTAP gated: no BSSAP/SCCP/MTP3 partners"),
    (f"family = '2g3g' and not ({DTAP_MATCHED} and not {has(*rules.LEGACY_PARTNERS)}) and not {STRONG_LEGACY}", 0.45,
     "legacy evidence partial: no strong SS7 partner combo"),
    (f"family = '2g3g' and {DTAP_MATCHED} and {DTAP_COUNT} > 0 and {DTAP_COUNT} < greatest(5, floor(total_packets * 0.01D)) and not {STRONG_LEGACY}", 0.5,
     "rare dtap signal treated as a side signal"),
    (f"{named(*rules.HYBRID_VOICE)} and not {VOICE}", 0.35, "voice profile downranked: no SIP/IMS indicators"),
    (f"startswith(profile, 'vonr-') and not {named(*rules.HYBRID_VOICE)} and not {has('ngap', 'nas-5gs')}", 0.3,
     "VoNR profile downranked: no 5G SA context (ngap/nas-5gs) detected"),
    (f"{named(*both_ims)} and {IMS_MISSING}", 0.3, "IMS Diameter/core profile downranked: no IMS peer or signaling hints"),
    (f"{named(*only_diameter)} and {IMS_MISSING}", 0.35, "IMS Diameter profile downranked: no IMS peer or signaling hints"),
    (f"{named(*only_core)} and {IMS_MISSING}", 0.3, "IMS core profile downranked: no IMS peer or signaling hints"),
    (f"{named(*rules.IMS_CORE)} and {VOICE} and not ({has('diameter')} or {IMS_HINT})", 0.4,
     "IMS core profile downranked: SIP alone is insufficient — Diameter or IMS peer evidence needed"),
    (f"{named(*rules.VOICE_SIP)} and not ({has('sip')} or {IMS_HINT})", 0.12, "SIP voice profile downranked: no SIP or IMS hints"),
    (f"endswith(profile, '-sip-call') and not {CALL}", 0.4, "SIP call profile downranked: no SDP/media call markers"),
    (f"endswith(profile, '-sip-register') and not {REGISTER}", 0.25, "SIP register profile downranked: no registrar/auth-style context"),
    (f"endswith(profile, '-sbc') and not {SBC}", 0.35, "SBC profile downranked: no SBC peer or topology hints"),
    (f"{named(*rules.VOICE_DNS)} and not ({has('sip')} or {IMS_HINT})", 0.55, "voice DNS profile downranked: no IMS hints"),
    (f"profile = '5g-n26' and not {INTERWORKING} and {EPS_ONLY}", 0.1,
     "N26 profile suppressed: clear EPS/GTPv2 context without any 5GC indicators"),
    (f"profile = '5g-n26' and not {INTERWORKING} and not {EPS_ONLY}", 0.3, "N26 profile downranked: no EPC↔5GC interworking hints"),
    (f"profile = '5g-dns' and not ({has('ngap', 'nas-5gs')} or {hint(rules.HINTS['dns5g'])})", 0.4,
     "5G DNS profile downranked: no 5G anchor (ngap/nas-5gs) detected"),
    (f"profile = 'lte-dns' and not ({has('s1ap', 'nas-eps', 'diameter', 'gtpv2')} or {hint(rules.HINTS['dnslte'])})", 0.4,
     "LTE DNS profile downranked: no LTE anchor (s1ap/diameter/gtpv2) detected"),
    (f"endswith(profile, '-dns') and not {named('lte-dns', '5g-dns')} and not {IMS_HINT}"
     f" and not {has('ngap', 'nas-5gs', 's1ap', 'nas-eps', 'sip', 'sdp')}", 0.25,
     "family-specific DNS profile downranked: no domain context beyond DNS"),
    (f"{named('2g3g-isup', 'isup')} and not {has('isup')}", 0.0, "ISUP profile suppressed: no isup protocol evidence detected"),
    (f"profile = '2g3g-bssap' and not {BSSAP}", 0.0, "BSSAP profile suppressed: no BSSAP/BSSMAP evidence"),
    (f"profile = '2g3g-geran' and not {GERAN}", 0.0, "GERAN profile suppressed: no BSSAP/DTAP/GSM-A evidence"),
    (f"profile = '2g3g-ss7-geran' and not {GERAN}", 0.0, "legacy GERAN bundle suppressed: no BSSAP/DTAP/GSM-A evidence"),
    (f"profile = '2g3g-gs' and not ({BSSAP} or {has('dtap')})", 0.0, "Gs interface profile suppressed: no BSSAP/DTAP evidence"),
    (f"profile = '2g3g-gn' and not {GTP1}", 0.0, "Gn profile not applicable: no GTPv1 evidence detected"),
    (f"profile = '2g3g-gn' and {GTP1} and {GTP2}", 0.0,
     "Gn profile not applicable: GTPv2 control plane present — GTP user-plane is LTE-U, not legacy Gn"),
    (f"profile = '2g3g-gp' and not {GTP1}", 0.0, "Gp profile not applicable: no GTPv1 evidence detected"),
    (f"profile = '2g3g-gp' and {GTP1} and {GTP2}", 0.0,
     "Gp profile not applicable: GTPv2 control plane present — GTP user-plane is LTE-U, not legacy Gp/roaming"),
    (f"{named('lte-s5', 'lte-s8')} and {GTP1} and not {GTP2}", 0.12,
     "lte-s5/s8 downranked: GTP (v1) without GTPv2 control plane — suggests legacy Gn/Gp, not LTE S5/S8"),
    (f"{SPECIFIC_SBI} and not ({SBI_HINT})", 0.3, "specific SBI interface downranked because no NF or interface hints were detected"),
]
# (condition, bonus, reason)
BONUSES = [
    (f"{named(*rules.IMS_DIAMETER)} and {IMS_HINT}", 0.6, "resolved peer hints reinforce IMS/CSCF Diameter context"),
    (f"{named(*rules.IMS_CORE)} and {has('diameter')} and {IMS_HINT}", 1.0, "Diameter plus IMS peer hints support broad IMS core context"),
    (f"endswith(profile, '-sip-call') and {CALL}", 0.9, "SDP/media markers support call-flow specialization"),
    (f"endswith(profile, '-sip-register') and {REGISTER}", 0.8, "registrar/auth-style hints support registration specialization"),
    (f"endswith(profile, '-sbc') and {SBC}", 0.9, "resolved peer hints support SBC boundary interpretation"),
    (f"profile = 'lte-s6a' and ({roles('mme', 'hss')} or {hint(rules.HINTS['s6a'])})", 1.2,
     "protocol evidence is partial; resolved peer hints strongly suggest MME/HSS Diameter context"),
    (f"{named('lte-s5', 'lte-s8')} and ({roles('sgw', 'pgw')} or {hint(rules.HINTS['s5s8'])})", 1.5,
     "protocol evidence is partial; resolved peer hints strongly suggest S5/S8 context"),
    (f"profile = 'lte-s11' and ({roles('mme', 'sgw')} or {hint(rules.HINTS['s11'])})", 1.1,
     "protocol evidence is partial; resolved peer hints suggest S11 MME↔SGW context"),
    (f"profile = 'lte-s10' and {hint(rules.HINTS['s10'])}", 1.1,
     "protocol evidence is partial; resolved peer hints suggest S10 inter-MME context"),
    (f"profile = '5g-n26' and {hint(rules.HINTS['n26'])}", 1.0,
     "protocol evidence is partial; resolved peer hints suggest EPC↔5GC interworking context"),
    (f"{named(*rules.VOICE_DNS)} and {IMS_HINT}", 0.8,
     "protocol evidence is partial; resolved peer hints suggest IMS-oriented DNS context"),
    (f"{named('2g3g-map-core', '2g3g-gr')} and {has_all('map', 'tcap', 'sccp')}", 0.5,
     "strong MAP/TCAP/SCCP combo supports core SS7 context"),
    (f"profile = '5g-sbi' and {has_all('http', 'json')} and not {ANY_SBI_HINT}", 1.2,
     "generic SBI candidate favored because no specific NF/interface hints were detected"),
    (f"profile = '5g-core' and {has_all('http', 'json')} and not {ANY_SBI_HINT}", 2.0,
     "generic 5G core candidate kept prominent because SBI traffic is broad but unspecific"),
]
TOP_IS_5G = "top_domain in ('5g-sa-core', '5g-sa-core-sbi')"
LTE_ANCHOR = has(*rules.LTE_ANCHORS)
# (condition, factor, reason in SQL); the first that holds counts, and only below a clear first domain
MISMATCHES = [
    (f"family = 'lte' and {TOP_IS_5G} and {has('nas-eps')} and not {LTE_ANCHOR}", 0.35,
     "concat('treated as cross-generation side signal; primary domain evidence points to ', top_domain)"),
    (f"family = 'lte' and {TOP_IS_5G} and not {has('nas-eps')} and not {LTE_ANCHOR}", 0.15,
     "'LTE profile suppressed: no LTE anchor signal in strongly 5G SA dominated trace'"),
    ("family = '2g3g' and top_family in ('5g', 'lte') and not array_contains(families, '2g3g')", 0.25,
     "concat('strong ', top_domain, ' evidence outweighs weak legacy side signals')"),
    ("family in ('5g', 'lte') and top_family = '2g3g' and not array_contains(families, family)", 0.35,
     "concat('strong ', top_domain, ' evidence outweighs weak modern side signals')"),
    ("startswith(profile, 'vonr-') and top_domain = 'lte-eps' and not array_contains(families, '5g')", 0.55,
     "'voice-over-5GS profile downranked because primary domain evidence points to LTE/EPS'"),
    ("startswith(profile, 'volte-') and top_family = '5g' and not array_contains(families, 'lte')", 0.55,
     "'VoLTE/EPS voice profile downranked because primary domain evidence points to 5G SA'"),
    (f"(startswith(profile, 'vonr-') or startswith(profile, 'volte-')) and top_family = '5g' and not {VOICE}", 0.2,
     "'voice profile suppressed: primary domain is 5G SA with no voice evidence detected'"),
]
CLEAR_DOMAIN = 0.75
DOMAIN_BONUS = 3.0


def _held(table: list[tuple[str, float, str]]) -> str:
    """SQL array of (v, r) of the rules that hold, in table order."""
    rows = ", ".join(f"if({cond}, struct({value}D as v, '{reason}' as r), null)" for cond, value, reason in table)
    return f"filter(array({rows}), x -> x is not null)"


def family_of(domain: str) -> str:
    table = ", ".join(f"'{d}', '{f}'" for d, f in rules.DOMAIN_FAMILY.items())
    return f"map({table})[{domain}]"


# ------------------------------------------------------------------ scoring
def with_profiles(captures: DataFrame, profiles: Iterable[Profile]) -> DataFrame:
    """One row per capture and profile."""
    text = json.dumps(profile_rows(profiles)).replace("\\", "\\\\").replace("'", "\\'")
    return captures.selectExpr("*", f"inline(from_json('{text}', 'array<struct<{PROFILE_SCHEMA.replace(' string', ':string').replace(' array', ':array')}>>'))")


def base_scores(rows: DataFrame) -> DataFrame:
    """Add ``matched`` protocols, ``base`` score and its ``reasons``."""
    usable = lambda items: f"filter({items}, p -> not array_contains({TRANSPORT}, p) and ev[p].factor > 0)"
    rows = rows.selectExpr(
        "*",
        f"{usable('strong')} as strong_hit",
        f"{usable('array_except(triggers, strong)')} as trigger_hit",
        f"{usable('array_except(weak, concat(strong, triggers))')} as weak_hit",
    )
    total = "0D"
    for items, weight in (("strong_hit", 5.0), ("trigger_hit", 2.0), ("weak_hit", 0.5)):
        total = f"aggregate({items}, {total}, (a, p) -> a + {weight}D * ev[p].factor)"
    carried = lambda p, v: f"if(array_contains(relevant, '{p}') and ev['{p}'].factor > 0, {v}D, 0D)"
    names = "case when strong_names >= 2 then 4.0D when strong_names = 1 then 2.5D when supporting_names >= 3 then 1.5D when supporting_names >= 1 then 0.8D else 0D end"
    rows = rows.selectExpr("*", f"profile = '{NAMING_PROFILE}' as naming", f"{total} as signal")
    transports = f"(0D + {carried('sctp', 0.5)} + {carried('tcp', 0.2)} + {carried('udp', 0.2)})"
    plain_reasons = (
        f"concat(transform(strong_hit, p -> concat({protocol_reason('p')}, ' (strong)')), transform(trigger_hit, p -> {protocol_reason('p')}),"
        f" transform(weak_hit, p -> concat('supporting: ', {protocol_reason('p')})),"
        " if(signal > 0 and array_contains(relevant, 'sctp') and ev['sctp'].factor > 0, array('sctp transport present'), cast(array() as array<string>)))"
    )
    naming_said = f"concat(naming_reasons, array({protocol_reason(repr('dns'))}))"
    none = "cast(array() as array<string>)"
    return rows.selectExpr(
        "*",
        "if(naming, array('dns'), concat(strong_hit, trigger_hit, weak_hit)) as matched",
        f"if(naming, if(coalesce(ev['dns'].factor, 0) > 0, 2.5D * ev['dns'].factor + {names}, 0D), if(signal > 0, signal + {transports}, 0D)) as base",
        f"if(naming, if(coalesce(ev['dns'].factor, 0) > 0, {naming_said}, {none}), {plain_reasons}) as said",
    )


def gated(rows: DataFrame) -> DataFrame:
    """Multiply by every gate that holds."""
    rows = rows.withColumn("gates", F.expr(f"if(base > 0, {_held(GATES)}, cast(array() as array<struct<v:double,r:string>>))"))
    return rows.selectExpr(
        "*", "aggregate(gates, base, (a, g) -> a * g.v) as gated", "array_distinct(concat(said, transform(gates, g -> g.r))) as gate_reasons"
    )


def aligned_scores(rows: DataFrame) -> DataFrame:
    """Add domain alignment, context and mismatch: ``scored`` and its ``reasons``."""
    rows = rows.selectExpr(
        "*",
        "get(domains, 0).domain as top_domain",
        "coalesce(get(domains, 0).score, 0D) as top_score",
        f"{family_of('get(domains, 0).domain')} as top_family",
        f"transform(domains, d -> {family_of('d.domain')}) as families",
    )
    bonus = (
        f"case when d.domain = domain then d.score * {DOMAIN_BONUS}D when {family_of('d.domain')} = family then d.score * {DOMAIN_BONUS * 0.7!r}D else 0D end"
    )
    aligned = (
        "aggregate(domains, struct(0D as v, cast(null as string) as r),"
        f" (a, d) -> if({bonus} > a.v, struct({bonus} as v, concat('aligned with suspected domain ', d.domain) as r), a))"
    )
    mismatch = " ".join(f"when {cond} then struct({factor}D as v, {reason} as r)" for cond, factor, reason in MISMATCHES)
    plain = "struct(1D as v, cast(null as string) as r)"
    rows = rows.selectExpr(
        "*",
        f"{aligned} as aligned",
        f"{_held(BONUSES)} as bonuses",
        f"if(top_family is not null and top_score >= {CLEAR_DOMAIN}, case {mismatch} else {plain} end, {plain}) as mismatch",
    )
    score = "if(gated > 0, (gated + aligned.v + aggregate(bonuses, 0D, (a, b) -> a + b.v)) * mismatch.v, gated)"
    said = "array_compact(concat(gate_reasons, array(aligned.r), transform(bonuses, b -> b.r), array(mismatch.r)))"
    rank = """case when startswith(r, 'aligned with suspected domain') then 0 when startswith(r, 'treated as cross-generation side signal') then 1
      when startswith(r, 'voice profile downranked') then 2 when contains(r, 'outweighs weak') then 3
      when contains(r, 'telecom core naming') or contains(r, 'telecom core DNS naming') then 5 else 10 end"""
    ordered = f"transform(array_sort(transform(array_distinct({said}), r -> struct({rank} as k, r as r))), s -> s.r)"
    fallback = f"if(size(gate_reasons) = 0, array('{NO_MATCH}'), gate_reasons)"
    return rows.selectExpr("*", f"{score} as scored", f"if(gated > 0, {ordered}, {fallback}) as reasons")


def with_naming_score(captures: DataFrame, profiles: Iterable[Profile]) -> DataFrame:
    """Add the score of the naming profile to each capture: its one row per capture is scored first, so that no window has to find it."""
    naming = [p for p in profiles if p.name == NAMING_PROFILE]
    if not naming:
        return captures.withColumn("naming_score", F.lit(0.0))
    rows = aligned_scores(gated(base_scores(with_profiles(captures, naming))))
    return rows.selectExpr(*[f"`{c}`" for c in captures.columns], "if(gated > 0, scored, 0D) as naming_score")


def final_scores(rows: DataFrame) -> DataFrame:
    """Scores with DNS profiles damped below a clear naming profile; rows carry ``naming_score``."""
    rows = aligned_scores(rows)
    # a strong naming profile without any signalling anchor explains the DNS traffic better
    fan_out = f"naming_score >= 4.0 and not {has(*rules.FANOUT_ANCHORS)} and gated > 0 and not naming and not ({named(*rules.VOICE_DNS)} and {IMS_HINT})"
    rows = rows.withColumn("damp", F.expr(f"case when {fan_out} and endswith(profile, '-dns') then 'dns' when {fan_out} and {named(*rules.FANOUT_CORE)} then 'core' end"))
    return select_once(
        rows,
        "capture_id", "profile", "family", "domain as profile_domain", "interface", "strong", "triggers", "weak", "ev", "total_packets",
        "strong_names", "supporting_names", "naming", "gated > 0 as is_scored",
        "case damp when 'dns' then scored * 0.3D when 'core' then scored * 0.35D else scored end as score",
        "array_distinct(concat(reasons, case damp"
        " when 'dns' then array('downranked: telecom core naming support profile provides the stronger explanation')"
        " when 'core' then array('downranked: family-specific profile without signaling anchor in DNS support trace')"
        " else cast(array() as array<string>) end)) as reasons",
    )


def with_confidence(rows: DataFrame) -> DataFrame:
    """Add ``confidence`` and ``evidence_class``."""
    listed = f"filter(concat(strong, triggers, weak), p -> not array_contains({TRANSPORT}, p))"
    rows = rows.selectExpr(
        "*",
        f"size(filter({listed}, p -> ev[p].source = 'count')) as hits",
        f"size(filter({listed}, p -> ev[p].source = 'raw')) as raw_hits",
        "exists(reasons, r -> contains(r, 'resolved peer hints')) as hosts",
    )
    pair = lambda c, e: f"struct('{c}' as confidence, '{e}' as evidence_class)"
    hinted = lambda c, with_hosts, without: f"if(hosts, {pair(c, with_hosts)}, {pair(c, without)})"
    graded = f"""case
      when naming and coalesce(ev['dns'].factor, 0) = 0 then {pair('low', 'weak')}
      when naming and strong_names >= 2 then {pair('high', 'protocol_strong')}
      when naming and (strong_names = 1 or supporting_names >= 2) then {pair('medium', 'protocol_partial')}
      when naming then {pair('low', 'protocol_partial')}
      when {named('lte-s5', 'lte-s8')} and coalesce(ev['gtpv2'].packets, 0) = 0 and coalesce(ev['gtp'].packets, 0) > 0
        then {hinted('low', 'protocol_partial_with_host_hints', 'protocol_partial')}
      when hits >= 2 then {hinted('high', 'protocol_strong_with_host_hints', 'protocol_strong')}
      when hits >= 1 and raw_hits >= 1 and hosts then {pair('medium', 'protocol_partial_with_host_hints')}
      when hits >= 1 then {pair('medium', 'protocol_partial')}
      when raw_hits >= 1 then {hinted('low', 'protocol_partial_with_host_hints', 'raw_protocol_partial')}
      else {hinted('low', 'host_hints_only', 'weak')} end"""
    return rows.withColumn("g", F.expr(graded)).select("*", "g.*").drop("g", "hits", "raw_hits", "hosts")


def score_profiles(captures: DataFrame, profiles: Iterable[Profile]) -> DataFrame:
    """Every capture and profile with its final score; ``captures`` carries evidence and domains.

    The one row of a capture goes to its partition before it meets the profiles, so that the windows over them move nothing.
    """
    profiles = list(profiles)
    dealt = with_naming_score(captures, profiles).repartition("capture_id")
    return final_scores(gated(base_scores(with_profiles(dealt, profiles))))


def recommended(scored: DataFrame, limit: int = 8) -> DataFrame:
    """Best profiles per capture."""
    order = Window.partitionBy("capture_id").orderBy(F.col("score").desc(), "profile")
    rows = scored.where("is_scored").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return with_confidence(rows).selectExpr(
        "capture_id", "rank", "profile", "round(score, 2) as score", "slice(reasons, 1, 5) as reasons", "confidence", "evidence_class",
        "family", "profile_domain", "interface",
    )


def suppressed(scored: DataFrame, limit: int = 8) -> DataFrame:
    """Profiles without a score, with the reason."""
    order = Window.partitionBy("capture_id").orderBy("score", "profile")
    rows = scored.where("not is_scored").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return rows.selectExpr("capture_id", "rank", "profile", "round(score, 2) as score", "slice(reasons, 1, 3) as reasons")


def best_profile(captures: DataFrame, ranked: DataFrame, default: str = "lte-core") -> DataFrame:
    """First candidate per capture, or the default."""
    first = ranked.where("rank = 1").select("capture_id", "profile")
    return captures.select("capture_id").join(first, "capture_id", "left").withColumn("profile", F.coalesce("profile", F.lit(default)))
