"""Findings, warnings, excerpts and overviews of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import tables
from tracemill.functions.ordering import first_rows
from tracemill.functions.pseudonym import blake_hex_list
from tracemill.operators.privacy import protect_payload
from tracemill.operators.stats import observed_protocols

SLOW_P95_MS = 500


def short_number(col: str) -> str:
    """SQL text of a number with up to three decimals and at least one."""
    return f"regexp_replace(cast(cast({col} as decimal(30,3)) as string), '0{{1,2}}$', '')"


def findings(anomaly_counts: DataFrame, detail_counts: DataFrame, gaps: DataFrame, bursts: DataFrame) -> DataFrame:
    """(capture_id, ord, text): anomalies, the three largest protocols, slow gaps, bursts.

    Anomalies are those of the whole capture; the rest describes the detail window.
    """
    per_layer = anomaly_counts.groupBy("capture_id").agg(
        F.sum("anomalies").alias("n"), F.sort_array(F.collect_list(F.struct("layer", "anomalies"))).alias("l")
    )
    total = per_layer.selectExpr(
        "capture_id", "0 as ord",
        "concat(n, ' anomalies detected (', array_join(transform(l, x -> concat(x.layer, ': ', x.anomalies)), ', '), ')') as text",
    )
    largest = observed_protocols(detail_counts, 3).selectExpr(
        "capture_id", "rank as ord", "concat(protocol, ' accounts for ', packets, ' normalized packets') as text"
    )
    slow = gaps.where(F.col("gap_p95") > SLOW_P95_MS).selectExpr(
        "capture_id", "10 as ord", f"concat('High p95 inter-packet delay: ', {short_number('gap_p95')}, ' ms — possible congestion or gaps') as text"
    )
    found = bursts.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
    found = found.selectExpr("capture_id", "11 as ord", "concat(n, ' burst period(s) detected (≥5 packets within 1 s)') as text")
    return total.unionByName(largest).unionByName(slow).unionByName(found)


def finding_lists(rows: DataFrame) -> DataFrame:
    """At most six findings per capture as one array in reading order."""
    listed = rows.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("f"))
    return listed.selectExpr("capture_id", "transform(f, x -> x.text) as deterministic_findings")


def count_maps(counts: DataFrame, name: str, out: str) -> DataFrame:
    """Counts per capture as a map; the names are a small vocabulary."""
    return counts.groupBy("capture_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "packets")))).alias(out))


def summary_rows(
    meta: DataFrame,
    conversations: DataFrame,
    detail_counts: DataFrame,
    transports: DataFrame,
    anomaly_counts: DataFrame,
    found: DataFrame,
    coverage: DataFrame,
    gaps: DataFrame,
    profile: str,
    modes: dict[str, str],
) -> DataFrame:
    """One summary row per capture.

    Lists without a bound (anomaly texts, bursts, resolved peers) are tables of their own, see
    the sinks; the row holds their counts.
    """
    talk = conversations.groupBy("capture_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", F.struct("transport", "src", "dst", "top_protocol", "packet_count").alias("c")))),
            lambda x: x["c"],
        ).alias("conversations")
    )
    timing = gaps.select(
        "capture_id",
        F.expr(
            "struct(packet_count, duration_ms, struct(gap_min as min, gap_max as max, gap_mean as mean, gap_p95 as p95) as inter_packet_ms)"
        ).alias("timing_stats"),
    )
    layers = anomaly_counts.groupBy("capture_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", "anomalies")))).alias("anomaly_counts_by_layer")
    )
    cover = coverage.select("capture_id", F.struct(*[c for c in coverage.columns if c != "capture_id"]).alias("coverage"))
    rows = meta
    for part in (
        talk, count_maps(detail_counts, "protocol", "top_protocols"), count_maps(transports, "transport", "transport"),
        layers, finding_lists(found), cover, timing,
    ):
        rows = rows.join(part, "capture_id", "left")
    mode_map = ", ".join(f"'{c}', '{m}'" for c, m in modes.items())
    return rows.selectExpr(
        "capture_id",
        "'1.0' as schema_version",
        f"'{profile}' as profile",
        "struct(packet_count, first_packet_number, last_packet_number, first_seen_epoch, last_seen_epoch, raw_protocols) as capture_metadata",
        "relevant_protocols",
        "conversations",
        "struct(packet_count as total_packets, top_protocols, transport) as packet_message_counts",
        "anomaly_counts_by_layer",
        "deterministic_findings",
        "coverage",
        "timing_stats",
        f"map({mode_map}) as privacy_modes" if mode_map else "cast(map() as map<string,string>) as privacy_modes",
    )


def with_audit(summary: DataFrame, dropped: DataFrame, reports: DataFrame) -> DataFrame:
    """Add ``dropped_packets`` and ``privacy_audit`` (distinct pseudonymised values per class) to summary rows; null where there is none."""
    issued = reports.select("capture_id", F.explode("report").alias("r")).where("r.alias is not null")
    per_class = issued.select("capture_id", "r.issued_class", "r.original").distinct().groupBy("capture_id", "issued_class").agg(F.count(F.lit(1)).alias("n"))
    audit = per_class.groupBy("capture_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("issued_class", "n")))).alias("privacy_audit"))
    lost = dropped.where("dropped_packets > 0").select("capture_id", "dropped_packets")
    return summary.join(lost, "capture_id", "left").join(audit, "capture_id", "left")


def quality_warnings(summary: DataFrame, pseudonyms: bool = False, size_guard: bool = True, oversize_guard: bool = True) -> DataFrame:
    """(capture_id, code, message) of what a reader of the result should know."""
    rules = [
        ("coalesce(coverage.detail_truncated, false)", "detail_truncated",
         "coalesce(coverage.truncation_note, 'detail artifact was truncated by the configured packet limit.')"),
        (str(not size_guard).lower(), "capture_size_guard_disabled", "'pre-export capture size guard was disabled explicitly.'"),
        (str(not oversize_guard).lower(), "oversize_guard_disabled", "'packet-count oversize guard was disabled explicitly (--oversize-factor 0).'"),
        ("size(coalesce(relevant_protocols, array())) = 0", "no_relevant_protocols_detected", "'no relevant protocols were detected in the inspected capture.'"),
        (str(pseudonyms).lower(), "pseudonym_mapping_created", "'a pseudonym mapping sidecar was created and should be handled separately.'"),
    ]
    rows = ", ".join(f"if({cond}, struct('{code}' as code, {message} as message), null)" for cond, code, message in rules)
    return summary.selectExpr("capture_id", f"inline(filter(array({rows}), x -> x is not null))")


def excerpt(messages: DataFrame, max_messages: int, order: str = "packet_no", key: str = "capture_id") -> DataFrame:
    """First messages of each capture as one JSON array, with how many there are.

    A row holds at most ``max_messages`` of them; whoever wants all messages takes the rows themselves.
    """
    if max_messages <= 0:
        raise ValueError("an excerpt needs a limit above 0")
    available = messages.groupBy(key).agg(F.count(F.lit(1)).alias("available_messages"))
    row = F.struct(F.col(order).alias("_o"), F.struct(*[c for c in messages.columns if c != key]).alias("_m"))
    chosen = first_rows(messages, [key], order, max_messages).groupBy(key).agg(
        F.sort_array(F.collect_list(row)).alias("_rows"), F.count(F.lit(1)).alias("included_messages")
    )
    return available.join(chosen, key).selectExpr(
        key, "included_messages", "available_messages", "included_messages < available_messages as detail_excerpt_truncated",
        "to_json(transform(_rows, x -> x._m)) as messages",
    )


def complete(
    summary: DataFrame,
    files: DataFrame | None = None,
    digests: DataFrame | None = None,
    versions: DataFrame | None = None,
    action: str = "analyze",
    start_packet: int | None = None,
    end_packet: int | None = None,
) -> DataFrame:
    """The summary row with what identifies the run, the capture and the result.

    ``files`` is (capture_id, path), ``digests`` (capture_id, capture_sha256), ``versions`` (capture_id, version); what is not given is null.
    Anomaly texts and bursts have no bound and stay tables of their own.
    """
    rows = summary
    for part, columns in ((files, "path string"), (digests, "capture_sha256 string"), (versions, "version string")):
        name = columns.split()[0]
        if part is not None:
            rows = rows.join(part.select("capture_id", F.col(name).cast("string").alias(f"_{name}")), "capture_id", "left")
        else:
            rows = rows.withColumn(f"_{name}", F.lit(None).cast("string"))
    number = lambda n: "cast(null as bigint)" if n is None else f"{n}L"
    selection = "cast(null as struct<start_packet_number:bigint,end_packet_number:bigint>)"
    if start_packet is not None or end_packet is not None:
        selection = f"struct({number(start_packet)} as start_packet_number, {number(end_packet)} as end_packet_number)"
    classes = ", ".join(f"'{c}', array({', '.join(repr(k) for k in kinds)})" for c, kinds in tables.CANONICAL_CLASSES.items())
    return rows.selectExpr(
        f"struct('{action}' as action) as run",
        "struct(element_at(split(_path, '/'), -1) as filename, _path as path, capture_metadata.first_packet_number as first_packet_number,"
        " capture_metadata.first_seen_epoch as first_seen, capture_metadata.last_seen_epoch as last_seen) as capture",
        "struct(_version as version) as artifact",
        "date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as generated_at",
        "_capture_sha256 as capture_sha256",
        "'summary_sidecar' as artifact_role",
        "* except (_path, _capture_sha256, _version)",
        "deterministic_findings as probable_notable_findings",
        f"struct(array('generic', 'protocol-aware', 'privacy-profile-overrides') as rule_layers, map({classes}) as canonical_classes) as privacy_policy",
        f"{selection} as selection",
        "if(coverage.detail_truncated, struct(coverage.detail_packets_included as included, coverage.detail_packets_available as total_exported,"
        " coverage.truncation_note as note), null) as detail_truncated",
    )


# What a handed-over summary holds.
HANDOFF_FIELDS = """
profile relevant_protocols conversations packet_message_counts anomalies anomaly_counts_by_layer deterministic_findings
probable_notable_findings coverage timing_stats burst_periods privacy_modes
""".split()


def handoff(summary: DataFrame, excerpts: DataFrame, modes: dict[str, str], numbering=None, key=None, digest_list=blake_hex_list) -> DataFrame:
    """(capture_id, summary, excerpt columns): the fields of a summary that are handed over, protected again, as one JSON text.

    Fields that are tables of their own here (anomalies, bursts) are left out of the text when the rows do not carry them.
    """
    kept = summary.select("capture_id", *[c for c in HANDOFF_FIELDS if c in summary.columns])
    hidden = protect_payload(kept, modes, numbering, key, digest_list=digest_list)
    text = hidden.select("capture_id", F.to_json(F.struct(*[c for c in hidden.columns if c != "capture_id"])).alias("summary"))
    return text.join(excerpts, "capture_id", "left")


def status_counts(results: DataFrame) -> DataFrame:
    """Captures per status, with the grand total."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("captures")).withColumn(
        "total", F.sum("captures").over(Window.partitionBy())
    )


# ------------------------------------------------------------------ artifact names
def safe_segment(text: str) -> str:
    """SQL text: a file-name part of letters, digits, dots, dashes and single underscores."""
    out = f"regexp_replace(trim({text}), r'\\s+', '_')"
    out = f"regexp_replace({out}, '[^A-Za-z0-9._-]+', '_')"
    out = f"regexp_replace(regexp_replace({out}, '_+', '_'), '^[._-]+|[._-]+$', '')"
    return f"coalesce(nullif({out}, ''), 'capture')"


def timestamp_segment(epoch: str) -> str:
    """SQL text: yyyymmdd_hhmmss of epoch seconds or ISO text, null when unreadable."""
    seconds = f"try_cast({epoch} as decimal(20,9))"
    wall_clock = f"try_to_timestamp(regexp_replace(regexp_replace({epoch}, r'([.]\\d{{6}})\\d+', '$1'), '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', ''))"
    moment = f"if({seconds} is not null, timestamp_micros(cast(floor({seconds} * 1000000) as bigint)), {wall_clock})"
    return f"date_format({moment}, 'yyyyMMdd_HHmmss')"


def artifact_prefix(action: str, stem: str, epoch: str, first_packet: str) -> str:
    tail = f"coalesce({timestamp_segment(epoch)}, concat('start_', coalesce(cast({first_packet} as string), 'unknown')))"
    return f"concat('{action}_', {safe_segment(stem)}, '_', {tail})"


def parse_artifacts(names: DataFrame, name: str = "name") -> DataFrame:
    """Add ``artifact_prefix`` and ``artifact_version`` of artifact file names, null for others."""
    pattern = r"^(.+)_V_([0-9]+)(_[^.]+)?[.]json$"
    return names.selectExpr(
        "*",
        f"nullif(regexp_extract({name}, r'{pattern}', 1), '') as artifact_prefix",
        f"try_cast(nullif(regexp_extract({name}, r'{pattern}', 2), '') as int) as artifact_version",
    )


def next_versions(existing: DataFrame) -> DataFrame:
    """(artifact_prefix, next_version): the smallest version from 1 that is still free."""
    used = existing.where("artifact_version >= 1").select("artifact_prefix", "artifact_version").distinct()
    placed = used.withColumn("place", F.row_number().over(Window.partitionBy("artifact_prefix").orderBy("artifact_version")))
    return placed.groupBy("artifact_prefix").agg(
        F.coalesce(F.min(F.when(F.col("artifact_version") != F.col("place"), F.col("place"))), F.max("place") + 1).alias("next_version")
    )
