"""The three ways through the library: inspect, discover, analyze.

Each takes DataFrames over any number of captures and gives a dictionary of tables keyed by
``capture_id``; the sinks write them.  Building them runs jobs: what several tables read is written once on the way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.tables import DETAIL_LIMIT, FLOW_EVENT_CAP, OVERSIZE_FACTOR
from tracemill.operators import anomalies as an
from tracemill.operators import classify, decode, domains, enrichment, evidence, flow, privacy, ranking, selection, stats, summary, timing
from tracemill.operators.endpoints import Lookups, attach, endpoint, occurrences, resolve, resolved_peers
from tracemill.operators.pairing import pair_events, write_back
from tracemill.session import cut_lineage
from tracemill.sources.packets import with_leaves
from tracemill.sources.profiles import Profile, builtin_profiles, discovery_profile


# How many rows per capture a discovery shows.
DISCOVER_PEERS, DISCOVER_CONVERSATIONS, DISCOVER_ANOMALIES = 10, 10, 20


@dataclass
class Options:
    profile: Profile = field(default_factory=lambda: builtin_profiles()["lte-core"])
    modes: dict[str, str] = field(default_factory=dict)
    numbering: privacy.Numbering = field(default_factory=privacy.Numbering)
    key: Column | None = None
    lookups: Lookups = field(default_factory=Lookups)
    max_packets: int = DETAIL_LIMIT
    oversize_factor: float = OVERSIZE_FACTOR
    fail_on_truncation: bool = False
    flow_events: int = FLOW_EVENT_CAP
    collapse_repeats: bool = True
    time_scale: float = 1.0
    pairing: str = "matches"  # or "events", see pair_events


def inspect(index: DataFrame, options: Options, profiles: dict[str, Profile] | None = None, candidates: int = 6) -> dict[str, DataFrame]:
    """Capture-wide statistics, peers, anomalies, domains, candidates and notes of a packet index."""
    profile = options.profile
    rows = classify.with_top_protocol(index, profile)
    base = cut_lineage(stats.cells(rows))
    counts, transports = stats.protocol_counts(base), stats.transport_counts(base)
    conversations = stats.top_conversations(stats.conversations(rows), profile.max_conversations)
    meta = stats.capture_meta(base, profile.relevant)
    seen = occurrences(rows, endpoint(F.col("src_ip"), F.col("src_port")), endpoint(F.col("dst_ip"), F.col("dst_port")))
    peers = resolved_peers(seen, resolve(seen.select("endpoint"), options.lookups))
    totals = base.groupBy("capture_id").agg(stats.packets_in(base).alias("total_packets"))
    facts = evidence.capture_evidence(totals, counts, transports, stats.raw_protocols(base), peers, stats.dns_names(base))
    # one small row per capture, read by every rule below
    captures = cut_lineage(domains.with_domains(cut_lineage(facts)))
    scored = ranking.score_profiles(captures, (profiles or builtin_profiles()).values())
    ranked = cut_lineage(ranking.recommended(scored, candidates))
    enriched = enrichment.enrich(captures, ranked)
    return {
        "meta": meta,
        "protocol_counts": counts,
        "transport_counts": transports,
        "conversations": conversations,
        "anomalies": an.with_network_anomalies(an.all_anomalies(rows, profile.name), enriched),
        "peers": peers,
        "captures": captures,
        "candidates": ranked,
        "suppressed": ranking.suppressed(scored, candidates),
        "best_profile": ranking.best_profile(captures, ranked),
        "dominant": domains.dominant_signalling(captures, primary_only=False).where("strength = 'strong'"),
        "enrichment": enriched,
    }


def discover(index: DataFrame, options: Options, profiles: dict[str, Profile] | None = None) -> dict[str, DataFrame]:
    """``inspect`` with the union of all profiles, eight candidates, and signalling by first domain."""
    known = profiles or builtin_profiles()
    broad = Options(profile=discovery_profile(known.values()), lookups=options.lookups)
    found = inspect(index, broad, known, candidates=8)
    captures = found["captures"]
    found["top_protocols"] = stats.top_protocols(found["protocol_counts"])
    found["conversations"] = found["conversations"].where(F.col("rank") <= DISCOVER_CONVERSATIONS)
    found["peer_counts"] = found["peers"].groupBy("capture_id").agg(F.count(F.lit(1)).alias("resolved_peers"))
    found["peers"] = stats.top_per_capture(found["peers"], DISCOVER_PEERS, F.col("ip")).drop("rank")
    found["anomalies"] = stats.top_per_capture(found["anomalies"], DISCOVER_ANOMALIES, F.col("section"), F.col("position")).drop("rank")
    found["dominant"] = domains.dominant_signalling(captures)
    found["relevant"] = domains.relevant_signalling(captures)
    found["context"] = domains.capture_context(captures)
    return found


def detail_packets(packets: DataFrame, options: Options) -> DataFrame:
    """Selected full packets ``(capture_id, layers)`` as normalised, named and reduced rows; malformed ones stay marked."""
    rows = decode.normalise(with_leaves(packets), options.profile, options.time_scale)
    side = lambda s: endpoint(F.col(f"{s}_ip"), F.col(f"transport.{s}_port"), F.col(f"{s}_point_code"))
    return attach(rows, options.lookups, side("src"), side("dst"))


def analyze(index: DataFrame, packets: DataFrame, options: Options) -> dict[str, DataFrame]:
    """Everything for the detail window: protected packets, summary, flow and reports.

    ``packets`` holds ``(capture_id, frame_no, layers)``, as ``read_packets`` gives them.  Guards run before any result is built.
    """
    privacy.check_key(index.sparkSession, options.modes, options.key)
    profile = options.profile
    rows = classify.with_top_protocol(index, profile)
    base = cut_lineage(stats.cells(rows))
    if options.oversize_factor > 0:
        selection.require_empty(
            selection.oversize(base, options.max_packets, options.oversize_factor), "captures far above the packet limit"
        )
    chosen = cut_lineage(selection.first_packets(index.select("capture_id", "frame_no"), options.max_packets))
    cover = selection.coverage(base, chosen)
    if options.fail_on_truncation:
        selection.require_empty(cover.where("detail_truncated"), "detail would be truncated")

    hide = lambda df, report=None: privacy.protect_payload(df, options.modes, options.numbering, options.key, report)
    meta = stats.capture_meta(base, profile.relevant)
    conversations = stats.top_conversations(stats.conversations(rows), profile.max_conversations)
    found = cut_lineage(hide(an.all_anomalies(rows, profile.name), "report"))
    layers = an.anomaly_counts(found)

    full = selection.selected_frames(packets, chosen).drop("frame_no")
    normal = detail_packets(full, options)
    # protected before anything is written; the report of the same pass goes with each packet
    landed = cut_lineage(
        privacy.protect_packets(decode.reduce_transport(normal, profile.transport_fields), options.modes, options.numbering, options.key, "report").drop(
            "src_ip", "dst_ip", "src_point_code", "dst_point_code"  # the endpoints hold them, protected
        )
    )
    good = landed.where("is_valid")
    detail = good.drop("report")
    counts = stats.protocol_counts(good, order="packet_no")
    gap_rows = timing.gap_stats(good, ["capture_id"], order="packet_no")
    burst_rows = timing.bursts(good, ["capture_id"], order="packet_no")
    findings = summary.findings(layers, counts, gap_rows, burst_rows)
    dropped = decode.dropped_packets(landed)
    summary_rows = hide(
        summary.summary_rows(
            meta, conversations, counts, stats.transport_counts(base), layers, findings, cover, gap_rows, profile.name, options.modes
        ),
        "report",
    )
    summary_rows = cut_lineage(summary_rows)

    shown = flow.capped(detail, options.flow_events)
    slim = cut_lineage(flow.flow_packets(shown))
    events = cut_lineage(flow.event_rows(flow.numbered(slim, options.collapse_repeats)))
    paired = write_back(events, pair_events(events, order=options.pairing))
    reports = good.select("capture_id", "report").unionAll(summary_rows.select("capture_id", "report")).unionAll(found.select("capture_id", "report"))
    pseudonyms = privacy.issued_pseudonyms(reports)
    summary_rows = summary.with_audit(summary_rows.drop("report"), dropped, reports)
    return {
        "detail": detail,
        "dropped": dropped,
        "summary": summary_rows,
        "anomalies": found.drop("report"),
        "bursts": burst_rows,
        "coverage": cover,
        "pseudonyms": pseudonyms,
        "privacy_audit": privacy.pseudonym_audit(pseudonyms),
        "leaks": privacy.open_leaves(reports, options.modes),
        "flow_events": paired,
        "flow_refs": flow.event_refs(flow.numbered(slim, options.collapse_repeats)),
        "flow_nodes": flow.nodes(slim, profile.name, few=options.flow_events > 0),
        "flow_phases": flow.phases(paired, profile.name),
        "flow_totals": flow.totals(detail, shown, paired, options.flow_events),
        "warnings": summary.quality_warnings(summary_rows),
    }
