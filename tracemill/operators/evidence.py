"""Protocol evidence per capture: how strongly each protocol is present, and what names hint at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import rules


def sql_list(items: Sequence[str]) -> str:
    return "array(" + ", ".join("'" + i.replace("'", "\\'") + "'" for i in items) + ")"


def _names(counts: DataFrame, transports: DataFrame, raw: DataFrame) -> DataFrame:
    """(capture_id, name, counted, carried): packets as top protocol and as transport; raw names with none."""
    zero = F.lit(0).cast("bigint")
    rows = (
        counts.select("capture_id", F.col("protocol").alias("name"), F.col("packets").alias("counted"), zero.alias("carried"))
        .unionByName(transports.select("capture_id", F.col("transport").alias("name"), zero.alias("counted"), F.col("packets").alias("carried")))
        .unionByName(raw.select("capture_id", F.col("protocol").alias("name"), zero.alias("counted"), zero.alias("carried")))
    )
    return rows.groupBy("capture_id", "name").agg(F.sum("counted").alias("counted"), F.sum("carried").alias("carried"))


def _owners(variants: dict[str, list[str]], keep_own: bool) -> str:
    """SQL array of the protocols that a name counts for."""
    owners: dict[str, list[str]] = {}
    for protocol, names in variants.items():
        for name in names:
            owners.setdefault(name, []).append(protocol)
    if keep_own:
        owners = {name: list(dict.fromkeys([name, *found])) for name, found in owners.items()}
    table = ", ".join(f"'{name}', {sql_list(found)}" for name, found in owners.items())
    return f"coalesce(map({table})[name], array(name))"


def evidence(
    counts: DataFrame, transports: DataFrame, raw: DataFrame, totals: DataFrame, signalling: bool = False
) -> DataFrame:
    """(capture_id, protocol, packets, factor, source) of every present protocol.

    Counted protocols weigh by their share of the packets, the others by a fixed factor.  Ranking
    keeps each spelling beside its common name, signalling only the common name.
    """
    variants = rules.SIGNALING_VARIANTS if signalling else rules.RANKING_VARIANTS
    transport = rules.SUPPORT_TRANSPORTS + rules.LINK_PROTOCOLS if signalling else rules.TRANSPORT_PROTOCOLS
    is_transport = lambda c: F.col(c).isin(transport)
    own = F.when(is_transport("name") & (F.col("counted") == 0), F.col("carried")).otherwise(F.col("counted"))
    spread = _names(counts, transports, raw).select(
        "capture_id", F.explode(F.expr(_owners(variants, not signalling))).alias("protocol"), own.alias("packets")
    )
    present = spread.groupBy("capture_id", "protocol").agg(F.sum("packets").alias("packets"))
    share = F.col("packets") / F.col("total_packets")
    frequency = F.lit(1.0)
    for below, factor in reversed(rules.FREQUENCY_STEPS):
        frequency = F.when(share < below, F.lit(factor)).otherwise(frequency)
    unseen = F.when(is_transport("protocol"), F.lit(rules.RAW_TRANSPORT_FACTOR)).otherwise(F.lit(rules.RAW_FACTOR))
    return present.join(totals.select("capture_id", "total_packets"), "capture_id").select(
        "capture_id",
        "protocol",
        "packets",
        F.when(F.col("packets") > 0, frequency).otherwise(unseen).alias("factor"),
        F.when(F.col("packets") > 0, "count").otherwise("raw").alias("source"),
    )


def evidence_map(ev: DataFrame, out: str) -> DataFrame:
    """One row per capture; the protocol vocabulary bounds the map."""
    entry = F.struct("protocol", F.struct("packets", "factor", "source"))
    return ev.groupBy("capture_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(out))


# ------------------------------------------------------------------ names
def found_words(names: DataFrame, words: Sequence[str], out: str) -> DataFrame:
    """Which of ``words`` occur in any name of a capture; names are ``(capture_id, name)``, lower case.

    A fixed number of flags per capture is aggregated, never the names themselves.
    """
    flags = names.groupBy("capture_id").agg(
        *[F.max(F.col("name").contains(w)).alias(f"w{i}") for i, w in enumerate(words)]
    )
    hits = ", ".join(f"if(w{i}, '{w}', null)" for i, w in enumerate(words))
    return flags.selectExpr("capture_id", f"array_compact(array({hits})) as {out}")


def naming_evidence(names: DataFrame) -> DataFrame:
    """Strong and supporting hits of telecom naming, and the reasons they give."""
    strong = [F.max(F.col("name").contains(t) if t else F.col("name").rlike(rules.OPERATOR_PATTERN)).alias(f"s{i}") for i, (t, _) in enumerate(rules.STRONG_NAMES)]
    weak = [F.max(F.col("name").contains(t)).alias(f"p{i}") for i, (t, _) in enumerate(rules.SUPPORTING_NAMES)]
    flags = names.groupBy("capture_id").agg(*strong, *weak)
    listed = lambda prefix, table: "array_compact(array(" + ", ".join(f"if({prefix}{i}, '{r}', null)" for i, (_, r) in enumerate(table)) + "))"
    rows = flags.selectExpr("capture_id", f"{listed('s', rules.STRONG_NAMES)} as strong", f"{listed('p', rules.SUPPORTING_NAMES)} as weak")
    reasons = f"""concat(
        case when size(strong) >= 1 then array('{rules.NAMING_SUMMARY_STRONG}') when size(weak) >= 2 then array('{rules.NAMING_SUMMARY_WEAK}')
          else cast(array() as array<string>) end,
        strong,
        case when size(strong) = 0 and size(weak) >= 2 then slice(weak, 1, 3) when size(strong) > 0 then slice(weak, 1, 2)
          else cast(array() as array<string>) end)"""
    return rows.selectExpr(
        "capture_id", "size(strong) as strong_names", "size(weak) as supporting_names", f"array_distinct({reasons}) as naming_reasons"
    )


def peer_words(peers: DataFrame) -> DataFrame:
    """Lower-case name, host name, alias, role and site of the peers, one row each."""
    fields = [c for c in ("name", "hostname", "alias", "role", "site") if c in peers.columns]
    return peers.select("capture_id", F.explode(F.array(*[F.lower(c) for c in fields])).alias("name")).where("name is not null")


def naming_words(dns: DataFrame, peers: DataFrame) -> DataFrame:
    """Sampled query names and peer names, lower case, one row each."""
    fields = [c for c in ("name", "hostname", "alias") if c in peers.columns]
    named = peers.select("capture_id", F.explode(F.array(*[F.lower(c) for c in fields])).alias("name")).where("name is not null")
    return dns.select("capture_id", F.lower("name").alias("name")).unionByName(named)


def capture_evidence(
    totals: DataFrame, counts: DataFrame, transports: DataFrame, raw: DataFrame, peers: DataFrame, dns: DataFrame
) -> DataFrame:
    """One row per capture with everything the ranking rules read.

    ``ev`` and ``sig`` map a protocol to (packets, factor, source); ``hints`` are words found in
    peer names, ``roles`` the peer roles.
    """
    empty = F.array().cast("array<string>")
    roles = peers.where("role is not null").select("capture_id", F.lower("role").alias("role")).distinct()
    known = sorted({w for group in rules.HINTS.values() for w in group} | {"mme", "hss", "sgw", "pgw", "sbc"})
    roles = roles.where(F.col("role").isin(known)).groupBy("capture_id").agg(F.sort_array(F.collect_list("role")).alias("roles"))
    rows = (
        totals.join(evidence_map(evidence(counts, transports, raw, totals), "ev"), "capture_id", "left")
        .join(evidence_map(evidence(counts, transports, raw, totals, signalling=True), "sig"), "capture_id", "left")
        .join(found_words(peer_words(peers), rules.all_hint_words(), "hints"), "capture_id", "left")
        .join(naming_evidence(naming_words(dns, peers)), "capture_id", "left")
        .join(roles, "capture_id", "left")
        .join(
            counts.groupBy("capture_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("protocol", "packets")))).alias("counts")),
            "capture_id",
            "left",
        )
        .join(
            transports.groupBy("capture_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("transport", "packets")))).alias("carried")),
            "capture_id",
            "left",
        )
    )
    none = "cast(map() as map<string,struct<packets:bigint,factor:double,source:string>>)"
    numbers = "cast(map() as map<string,bigint>)"
    return rows.select(
        "capture_id",
        "total_packets",
        F.expr(f"coalesce(ev, {none})").alias("ev"),
        F.expr(f"coalesce(sig, {none})").alias("sig"),
        F.expr(f"coalesce(counts, {numbers})").alias("counts"),
        F.expr(f"coalesce(carried, {numbers})").alias("carried"),
        F.coalesce("hints", empty).alias("hints"),
        F.coalesce("roles", empty).alias("roles"),
        F.coalesce("strong_names", F.lit(0)).alias("strong_names"),
        F.coalesce("supporting_names", F.lit(0)).alias("supporting_names"),
        F.coalesce("naming_reasons", empty).alias("naming_reasons"),
    ).withColumn("present", F.map_keys("ev"))
