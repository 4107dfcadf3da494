"""Network domain of a capture, and its dominant and relevant signalling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import rules
from tracemill.operators.evidence import sql_list

TRANSPORT = sql_list(rules.TRANSPORT_PROTOCOLS)


def protocol_reason(p: str, ev: str = "ev") -> str:
    """SQL text that says how a protocol is present."""
    counted = f"{ev}[{p}].packets > 0"
    return (
        f"concat({p}, if(array_contains({TRANSPORT}, {p}), if({counted}, concat(' transport present (', {ev}[{p}].packets, ' pkts)'), ' transport present'),"
        f" if({counted}, concat(' detected (', {ev}[{p}].packets, ' pkts)'), ' detected in raw_protocols')))"
    )


def _combo_table() -> str:
    """All rules as one SQL array; the plain-gtp rule comes last and has protocols that must be absent."""
    row = lambda i, need, without, members, domain, score, reason, plain: (
        f"struct({i} as ord, {sql_list(need)} as need, {sql_list(without) if without else 'cast(array() as array<string>)'} as without,"
        f" {sql_list(members)} as members, '{domain}' as domain, cast({score} as double) as score, '{reason}' as reason, {plain} as plain)"
    )
    rows = []
    for i, (protocols, domain, score, reason) in enumerate(rules.DOMAIN_COMBOS):
        need = protocols.split()
        rows.append(row(i, need, [], [p for p in need if p not in rules.TRANSPORT_PROTOCOLS], domain, score, reason, "false"))
    domain, score, reason = rules.GTP_FALLBACK
    rows.append(row(len(rows), ["gtp", "udp"], ["gtpv2", "gtpv1"], ["gtp"], domain, score, reason, "true"))
    return f"array({', '.join(rows)})"


def domain_rows(captures: DataFrame) -> DataFrame:
    """(capture_id, rank, domain, score, role, reasons): the best rule of each domain, damped by its rarest protocol."""
    tried = captures.selectExpr("capture_id", "ev", "present", f"inline({_combo_table()})")
    tried = tried.where(F.expr("size(array_except(need, present)) = 0 and not arrays_overlap(without, present)"))
    said = f"concat(array(reason), array_sort(transform(need, p -> {protocol_reason('p')})))"
    # a reason that another one continues is left out
    reasons = "filter(said, r -> not exists(said, o -> o <> r and startswith(o, r)))"
    scored = tried.selectExpr(
        "capture_id", "domain", "ord", "score * array_min(transform(members, p -> ev[p].factor)) as score", "reason", "plain", f"{said} as said"
    )
    scored = scored.selectExpr("capture_id", "domain", "ord", "score", f"if(plain, array(reason), array_distinct({reasons})) as reasons")
    best = (
        scored.where("score > 0")
        .groupBy("capture_id", "domain")
        .agg(
            F.max_by(F.struct("score", "reasons"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b"),
            F.min("ord").alias("first_ord"),
        )
    )
    others = F.count_if(F.col("domain") != "dns-support").over(Window.partitionBy("capture_id"))
    kept = best.withColumn("others", others).where(
        (F.col("b.score") >= rules.DOMAIN_THRESHOLD) & ~((F.col("domain") == "dns-support") & (F.col("others") > 0))
    )
    kept = kept.select("capture_id", "domain", F.round("b.score", 2).alias("score"), F.col("b.reasons").alias("reasons"), "first_ord")
    every = Window.partitionBy("capture_id")
    ranked = kept.withColumn("n", F.count(F.lit(1)).over(every)).withColumn(
        "rank", F.row_number().over(every.orderBy(F.col("score").desc(), "first_ord"))
    )
    role = F.expr("case when n = 1 or score >= 0.7 then 'primary' when score >= 0.4 then 'secondary' else 'supporting' end")
    return ranked.select("capture_id", "rank", "domain", "score", role.alias("role"), "reasons")


def with_domains(captures: DataFrame) -> DataFrame:
    """Add ``domains``, the ranked domains as an array."""
    row = F.struct("rank", "domain", "score", "role", "reasons")
    listed = domain_rows(captures).groupBy("capture_id").agg(F.sort_array(F.collect_list(row)).alias("domains"))
    none = F.expr("cast(array() as array<struct<rank:int,domain:string,score:double,role:string,reasons:array<string>>>)")
    return captures.join(listed, "capture_id", "left").withColumn("domains", F.coalesce("domains", none))


# ------------------------------------------------------------------ signalling
def protocol_role(p: str) -> str:
    return (
        f"case when array_contains({sql_list(rules.SIGNALING_PROTOCOLS)}, {p}) then 'domain_signaling'"
        f" when array_contains({sql_list(rules.SUPPORT_TRANSPORTS)}, {p}) then 'transport_support' else 'link_or_envelope_context' end"
    )


def signalling_rows(captures: DataFrame, primary_only: bool = True) -> DataFrame:
    """Present protocols per capture with role, evidence and priority, link protocols left out.

    Signalling known only from raw names counts when the first domain expects it.
    """
    rows = captures.selectExpr(
        "capture_id",
        "get(domains, 0).domain as primary_domain" if primary_only else "cast(null as string) as primary_domain",
        "explode(sig) as (protocol, e)",
    )
    expected = ", ".join(f"'{d}', {sql_list(p)}" for d, p in rules.DOMAIN_PROTOCOLS.items())
    priority = ", ".join(f"'{p}', {n}" for p, n in rules.SIGNAL_PRIORITY.items())
    rows = rows.selectExpr(
        "capture_id", "protocol", f"{protocol_role('protocol')} as role", "e.packets as packets", "e.factor as factor", "e.source as source",
        f"coalesce(map({priority})[protocol], 0) as priority", f"map({expected})[primary_domain] as expected",
    )
    wanted = "role <> 'link_or_envelope_context' and (role <> 'domain_signaling' or source = 'count' or expected is null or array_contains(expected, protocol))"
    return rows.where(wanted).drop("expected")


def _order(*first):
    return [
        *first, F.when(F.col("source") == "count", 0).otherwise(1), F.col("packets").desc(), F.col("factor").desc(),
        F.col("priority").desc(), F.col("protocol"),
    ]


def dominant_signalling(captures: DataFrame, limit: int = 10, primary_only: bool = True) -> DataFrame:
    """(capture_id, rank, protocol, strength, packets): strong signalling, or the first five; sctp is added last."""
    rows = signalling_rows(captures, primary_only)
    every = Window.partitionBy("capture_id")
    signals = rows.where("role = 'domain_signaling'")
    signals = signals.withColumn("place", F.row_number().over(every.orderBy(*_order())))
    signals = signals.withColumn("strong", F.count_if(F.col("factor") >= rules.DOMINANT_THRESHOLD).over(every))
    chosen = signals.where(F.expr(f"if(strong > 0, factor >= {rules.DOMINANT_THRESHOLD}, place <= 5)"))
    chosen = chosen.selectExpr("capture_id", "protocol", "if(source = 'count', 'strong', 'supporting') as strength", "packets", "place")
    carrier = rows.where("protocol = 'sctp'").join(chosen.select("capture_id").distinct(), "capture_id", "left_semi")
    carrier = carrier.selectExpr("capture_id", "protocol", "'supporting' as strength", "packets", "1000 as place")
    both = chosen.unionByName(carrier).withColumn("rank", F.row_number().over(every.orderBy("place")))
    return both.where(F.col("rank") <= limit).selectExpr("capture_id", "rank", "protocol", "strength", "nullif(packets, 0) as packets")


def relevant_signalling(captures: DataFrame, limit: int = 12) -> DataFrame:
    """(capture_id, rank, protocol): signalling first, then transports."""
    first = F.when(F.col("role") == "domain_signaling", 0).otherwise(1)
    ranked = signalling_rows(captures).withColumn("rank", F.row_number().over(Window.partitionBy("capture_id").orderBy(*_order(first))))
    return ranked.where(F.col("rank") <= limit).select("capture_id", "rank", "protocol")


def capture_context(captures: DataFrame) -> DataFrame:
    """Present link protocols and transports of each capture, sorted."""
    of = lambda role: f"array_sort(filter(map_keys(sig), p -> {protocol_role('p')} = '{role}'))"
    return captures.selectExpr(
        "capture_id", f"{of('link_or_envelope_context')} as link_or_envelope_protocols", f"{of('transport_support')} as transport_support_protocols"
    )
