"""Shape, notes, state and next steps of a capture, from its evidence, domains and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import rules
from tracemill.operators.domains import protocol_role
from tracemill.operators.evidence import sql_list

NOT_SIGNALING = sql_list(rules.SUPPORT_TRANSPORTS + rules.LINK_PROTOCOLS)
MODERN = "ngap nas-5gs s1ap nas-eps http".split()
LEGACY = "bssap dtap gsm_a isup map tcap".split()
CONTROL = "ngap s1ap diameter sip map gtpv2".split()
LARGE_CAPTURE = 5000
# Domain -> next step.
DOMAIN_STEPS = {
    "5g-sa-core": "5G SA Core signals detected — try profiles: 5g-n2, 5g-n1-n2, 5g-nas-5gs, 5g-sbi",
    "5g-sa-core-sbi": "5G SA Core signals detected — try profiles: 5g-n2, 5g-n1-n2, 5g-nas-5gs, 5g-sbi",
    "lte-eps": "LTE/EPS signals detected — try profiles: lte-s1, lte-s1-nas, lte-s6a, lte-s11",
    "ims-voice": "IMS/Voice signals detected — try profiles: volte-sip, volte-ims-core, vonr-sip",
    "legacy-2g3g": "2G/3G core signals detected — try profiles: 2g3g-map-core, 2g3g-geran, 2g3g-gn",
}


def with_candidates(captures: DataFrame, ranked: DataFrame) -> DataFrame:
    """Add ``candidates``, the ranked profiles as an array."""
    row = F.struct("rank", "profile", "score", "reasons", "confidence", "evidence_class")
    listed = ranked.groupBy("capture_id").agg(F.sort_array(F.collect_list(row)).alias("candidates"))
    none = "array<struct<rank:int,profile:string,score:double,reasons:array<string>,confidence:string,evidence_class:string>>"
    return captures.join(listed, "capture_id", "left").withColumn(
        "candidates", F.coalesce("candidates", F.expr(f"cast(array() as {none})"))
    )


def notes_of(*rows: tuple[str, str]) -> str:
    """SQL array of the texts whose condition holds; texts are SQL."""
    return "array_compact(array(" + ", ".join(f"if({cond}, {text}, null)" for cond, text in rows) + "))"


def with_shape(captures: DataFrame) -> DataFrame:
    """Add ``trace_shape`` and ``trace_shape_reasons``; ``captures`` carries counts, sig and domains."""
    rows = captures.selectExpr(
        "*",
        "aggregate(map_values(counts), 0L, (a, n) -> a + n) as counted",
        f"aggregate(map_entries(counts), 0L, (a, e) -> a + if(array_contains({NOT_SIGNALING}, e.key), 0L, e.value)) as signalling",
        f"array_sort(filter(map_keys(sig), p -> {protocol_role('p')} = 'domain_signaling')) as signals",
        "filter(domains, d -> d.score >= 0.6) as high",
        "filter(domains, d -> d.score >= 0.35 and d.score < 0.6) as medium",
    )
    shape = lambda name, reason: f"struct('{name}' as shape, array({reason}) as why)"
    names = lambda items, n: f"array_join(transform(slice({items}, 1, {n}), d -> d.domain), ', ')"
    coarse = "concat('decoded top protocols are coarse, but raw signaling hints are present: ', array_join(slice(signals, 1, 4), ', '))"
    chosen = f"""case
      when signalling / greatest(counted, 1) < 0.05 and size(signals) = 0 then {shape('transport_only', "'less than 5% signaling protocol traffic detected'")}
      when signalling / greatest(counted, 1) < 0.05 and size(domains) > 0 then {shape('single_domain', coarse)}
      when signalling / greatest(counted, 1) < 0.05 then {shape('unknown', coarse)}
      when size(high) + size(medium) = 0 then {shape('unknown', "'no domain signal strong enough to classify'")}
      when size(high) = 1 and size(medium) = 0 then {shape('single_domain', "concat('strong ', high[0].domain, ' signal, no competing domain')")}
      when size(high) >= 2 then {shape('mixed_domain', f"concat('co-dominant domains: ', {names('high', 3)})")}
      when size(high) = 1 then {shape('mixed_domain', f"concat('primary domain ', high[0].domain, '; secondary signals: ', {names('medium', 2)})")}
      when size(medium) = 1 then {shape('single_domain', "concat('moderate ', medium[0].domain, ' signal')")}
      else {shape('mixed_domain', f"concat('mixed moderate signals: ', {names('medium', 3)})")} end"""
    return rows.withColumn("_shape", F.expr(chosen)).selectExpr(
        "* except (_shape, high, medium)", "_shape.shape as trace_shape", "_shape.why as trace_shape_reasons"
    )


def with_refined(captures: DataFrame) -> DataFrame:
    """In a clear S6a capture, voice candidates that were downranked become low-confidence."""
    clear = (
        "trace_shape = 'single_domain' and get(domains, 0).domain = 'lte-eps' and get(domains, 0).score >= 0.7"
        " and get(candidates, 0).profile = 'lte-s6a' and map_contains_key(sig, 'diameter') and map_contains_key(sig, 'sctp')"
    )
    downranked = "startswith(c.profile, 'volte-') and exists(c.reasons, r -> contains(r, 'downranked') and contains(r, 'IMS'))"
    refined = (
        f"transform(candidates, c -> if({downranked}, named_struct('rank', c.rank, 'profile', c.profile, 'score', c.score, 'reasons', c.reasons,"
        " 'confidence', 'low', 'evidence_class', 'downranked_protocol_match'), c))"
    )
    rows = captures.selectExpr("*", f"coalesce({clear}, false) as clear_s6a", f"exists(candidates, c -> {downranked}) as any_downranked")
    return rows.withColumn("candidates", F.expr(f"if(clear_s6a, {refined}, candidates)"))


def with_notes(captures: DataFrame) -> DataFrame:
    """Add ``network_anomalies`` and ``classification_notes``."""
    n = lambda p: f"coalesce(counts['{p}'], 0)"
    any_of = lambda names: "(" + " or ".join(f"{n(p)} > 0" for p in names) + ")"
    legacy = "array_join(" + f"filter({sql_list(LEGACY)}, p -> coalesce(counts[p], 0) > 0)" + ", ', ')"
    some = "size(counts) > 0"
    anomalies = notes_of(
        ("size(counts) = 0", "'no protocols detected'"),
        (f"{some} and signalling = 0 and size(signals) = 0", "'transport-only trace: no application or signaling protocol decoded'"),
        (f"{some} and trace_shape = 'transport_only' and coalesce(carried['sctp'], 0) > 0 and signalling = 0",
         "\"SCTP flows present but no upper-layer protocol decoded — check port assignments or try --tshark-arg '-d sctp.port==<port>,<dissector>'\""),
        (f"{n('diameter')} > 0 and {n('diameter')} / greatest(counted, 1) < 0.03",
         "'diameter present but sparse — may need \\'--tshark-arg \"-d sctp.port==3868,diameter\"\\''"),
        (f"{n('http')} > 0 and {n('json')} = 0", "'HTTP/2 detected without JSON body visibility — SBI payload content may not be decoded'"),
        (f"{some} and trace_shape = 'mixed_domain'", "'mixed-domain trace — consider running discover for profile selection'"),
        (f"{any_of(MODERN)} and {any_of(LEGACY)}",
         f"concat('legacy protocol(s) present alongside modern signaling: ', {legacy}, ' — may indicate interworking trace or stray frames')"),
    )
    dns_only = f"{n('dns')} > 0 and not {any_of(CONTROL)}"
    hinted = "exists(slice(candidates, 1, 4), c -> c.evidence_class in ('host_hints_only', 'protocol_partial_with_host_hints'))"
    notes = notes_of(
        (f"{some} and signalling = 0 and size(signals) > 0",
         "'decoded top protocols are coarse; discovery is relying on raw signaling hints for classification'"),
        (dns_only, "'DNS-only trace with no control-plane signaling — may be a support-traffic-only capture'"),
        (dns_only, "'family assignment remains ambiguous — DNS-only without domain-specific service markers'"),
        (f"{some} and {hinted}", "'low-confidence specialization due to host hints; treat interface naming as plausible rather than fully proven'"),
        ("clear_s6a and any_downranked",
         "'downranked IMS Diameter candidates remain visible as generic Diameter/SCTP overlaps, not as strong IMS matches'"),
    )
    return captures.selectExpr("*", f"{anomalies} as network_anomalies", f"{notes} as classification_notes")


def with_state(captures: DataFrame) -> DataFrame:
    """Add ``classification_state``."""
    noted = lambda test: f"exists(classification_notes, n -> {test})"
    low_only = "size(candidates) > 0 and forall(slice(candidates, 1, 3), c -> c.confidence = 'low')"
    state = f"""case
      when trace_shape = 'transport_only' then 'unknown'
      when trace_shape = 'mixed_domain' then 'mixed'
      when {noted("contains(n, 'DNS') or contains(n, 'dns') or contains(n, 'ambiguous')")} or (size(domains) = 1 and domains[0].domain = 'dns-support') then 'ambiguous_support'
      when {noted("contains(lower(n), 'host hint') or contains(lower(n), 'partial')")} or ({low_only}) then 'partial'
      when size(domains) > 0 and domains[0].score >= 0.7 then 'confident'
      when size(domains) > 0 then 'partial'
      else 'unknown' end"""
    return captures.withColumn("classification_state", F.expr(state))


def with_hints(captures: DataFrame, command: str = "analyze <capture> --profile") -> DataFrame:
    """Add ``next_step_hints``; ``command`` is the text that names the analysis of one profile."""
    top = "get(candidates, 0).profile"
    known = "trace_shape <> 'transport_only' and size(domains) > 0"
    steps = ", ".join(f"'{d}', '{text}'" for d, text in DOMAIN_STEPS.items())
    hints = notes_of(
        ("trace_shape = 'transport_only'", "'run discover to see if a protocol dissector override is needed'"),
        ("trace_shape <> 'transport_only' and size(domains) = 0", "'no strong domain detected — run discover for broad protocol inventory'"),
        (f"{known} and trace_shape = 'single_domain' and size(candidates) > 0", f"concat('run: {command} ', {top})"),
        (f"{known} and trace_shape = 'mixed_domain'", "'mixed domains detected — run discover to see full candidate profile list'"),
        (f"{known} and trace_shape = 'mixed_domain' and size(candidates) > 0",
         f"concat('or run separate analyze passes per domain, starting with: --profile ', {top})"),
        (f"{known} and total_packets > {LARGE_CAPTURE} and clear_s6a",
         "'large capture — narrow first with `-Y \"diameter && sctp\"` before full S6a analyze'"),
        (f"{known} and total_packets > {LARGE_CAPTURE} and not clear_s6a",
         "'large capture — consider narrowing with -Y display filter before full analyze'"),
        (f"{known} and not clear_s6a", f"map({steps})[get(domains, 0).domain]"),
    )
    return captures.withColumn("next_step_hints", F.expr(hints))


def enrich(captures: DataFrame, ranked: DataFrame) -> DataFrame:
    """All of the above on captures that carry evidence and domains."""
    rows = with_refined(with_shape(with_candidates(captures, ranked)))
    return with_hints(with_state(with_notes(rows)))
