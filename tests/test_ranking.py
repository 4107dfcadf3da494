"""Domain inference, ranking and notes on hand-made captures; scores are worked out by hand."""

import pytest

from tracemill.operators import domains, enrichment, evidence, ranking
from tracemill.sources.profiles import builtin_profiles, discovery_profile

CAPTURES = {
    "n2": dict(counts={"ngap": 400, "nas-5gs": 80, "sctp": 500, "ip": 500}),
    "s1": dict(counts={"s1ap": 300, "nas-eps": 100, "sctp": 400, "ip": 400}),
    "s6a": dict(counts={"diameter": 200}, carried={"sctp": 200}, peers=[("mme1", "mme"), ("hss1", "hss")]),
    "naming": dict(counts={"dns": 100}, names=["apn.epc.mnc001.mcc262.3gppnetwork.org"]),
    "dnsonly": dict(counts={"dns": 100}),
    "flat": dict(counts={"ip": 497, "dtap": 3}, carried={"sctp": 500}, raw=["ip", "dtap", "ngap", "nas-5gs", "nas-eps", "sctp", "nr-rrc", "gsm_a.dtap"]),
    "lines": dict(counts={"tcp": 100, "ip": 50}),
    "rare": dict(counts={"ngap": 400, "nas-5gs": 80, "sctp": 500, "ip": 500, "dtap": 3, "bssap": 2}),
    "gtp": dict(counts={"gtp": 100}, carried={"udp": 100}),
    "call": dict(counts={"sip": 100, "sdp": 50}, carried={"udp": 150}),
    "sbi": dict(counts={"http": 50, "json": 50}, carried={"tcp": 100}),
    "many": dict(counts={p: 100 for p in "ngap nas-5gs http json pfcp s1ap diameter gtpv2 sip dns map".split()}),
}


@pytest.fixture(scope="module")
def captures(spark):
    counts, carried, raw, peers, names, totals = [], [], [], [], [], []
    for capture, parts in CAPTURES.items():
        total = sum(parts["counts"].values())
        totals.append((capture, total))
        counts += [(capture, p, n, i) for i, (p, n) in enumerate(parts["counts"].items())]
        carried += [(capture, p, n, i) for i, (p, n) in enumerate(parts.get("carried", {}).items())]
        raw += [(capture, p) for p in parts.get("raw", parts["counts"])]
        peers += [(capture, name, role) for name, role in parts.get("peers", [])]
        names += [(capture, n) for n in parts.get("names", [])]
    table = spark.createDataFrame
    facts = evidence.capture_evidence(
        table(totals, "capture_id string, total_packets bigint"),
        table(counts, "capture_id string, protocol string, packets bigint, first_frame bigint"),
        table(carried, "capture_id string, transport string, packets bigint, first_frame bigint"),
        table(raw, "capture_id string, protocol string"),
        table(peers, "capture_id string, name string, role string"),
        table(names, "capture_id string, name string"),
    )
    return domains.with_domains(facts).cache()


@pytest.fixture(scope="module")
def scored(captures):
    return ranking.score_profiles(captures, builtin_profiles().values()).cache()


def test_domains(captures):
    got = {r.capture_id: [(d.domain, d.score, d.role) for d in r.domains] for r in captures.select("capture_id", "domains").collect()}
    assert got["n2"] == [("5g-sa-core", 0.95, "primary")]
    assert got["s1"] == [("lte-eps", 0.95, "primary")]
    assert got["s6a"] == [("lte-eps", 0.72, "primary")]
    assert got["naming"] == [("dns-support", 0.4, "primary")]
    assert got["flat"][0][:2] == ("5g-sa-core", 0.81)
    assert got["lines"] == []
    assert [d for d, _, _ in got["rare"]] == ["5g-sa-core"]
    assert got["gtp"] == [("legacy-2g3g-gprs", 0.65, "primary")]
    assert got["call"] == [("ims-voice", 0.9, "primary")]
    assert got["sbi"] == [("5g-sa-core-sbi", 0.65, "primary")]


def test_domain_reasons_drop_what_others_continue(captures):
    got = {r.capture_id: r.domains[0].reasons for r in captures.where("size(domains) > 0").collect()}
    assert got["naming"] == ["dns detected (100 pkts)"]
    assert got["s6a"] == ["diameter + sctp = Diameter over SCTP (S6a / Cx / Rx)", "diameter detected (200 pkts)", "sctp transport present (200 pkts)"]


def score(scored, capture, profile):
    return scored.where((scored.capture_id == capture) & (scored.profile == profile)).first()


@pytest.mark.parametrize("capture, profile, want", [
    ("n2", "5g-n1-n2", 13.35), ("n2", "vonr-n1-n2-voice", 0.735), ("s1", "lte-s1", 12.495),
    ("s6a", "lte-s6a", 8.212), ("s6a", "volte-diameter-cx", 1.925), ("s6a", "lte-core", 6.512),
    ("naming", "core-name-resolution", 6.5), ("naming", "lte-dns", 0.6), ("naming", "volte-dns", 0.20625),
    ("dnsonly", "core-name-resolution", 2.5), ("dnsonly", "lte-dns", 2.0), ("dnsonly", "2g3g-dns", 5.0 * 0.45 * 0.25),
    ("gtp", "2g3g-gn", (2.0 * 0 + 5.0 * 0 + 5.0 + 0.2) * 0.45 + 0.65 * 2.1), ("gtp", "lte-s5", (2.0 * 0 + 5.0 + 0.2) * 0.12),
    ("sbi", "5g-core", 2.0 + 0.65 * 2.1 + 2.0), ("sbi", "5g-n10", (10.2) * 0.3 + 0.65 * 2.1), ("sbi", "5g-sbi", 10.2 + 0.65 * 2.1 + 1.2),
    ("call", "volte-sip-call", 5.2 + 0.9 + 0.9 * 2.1), ("call", "vonr-sip-call", 5.2 * 0.3 + 0.9 + 0.9 * 2.1),
])
def test_scores(scored, capture, profile, want):
    assert score(scored, capture, profile).score == pytest.approx(want, abs=1e-9)


def test_suppressed_profiles(scored):
    row = score(scored, "n2", "lte-s1")
    assert not row.is_scored and row.reasons == ["no matching protocol evidence"]
    assert "Gn profile not applicable" not in " ".join(score(scored, "gtp", "2g3g-gn").reasons)
    rows = ranking.suppressed(scored).where("capture_id = 'call'").orderBy("rank").collect()
    assert len(rows) == 8 and [r.profile for r in rows] == sorted(r.profile for r in rows)


def test_recommended(scored, captures):
    got = {}
    for r in ranking.recommended(scored).orderBy("capture_id", "rank").collect():
        got.setdefault(r.capture_id, []).append(r)
    assert [r.profile for r in got["n2"]][:3] == ["5g-n1-n2", "5g-nas-5gs", "5g-core"]
    assert got["s1"][0].profile == "lte-s1" and got["naming"][0].profile == "core-name-resolution"
    top = got["s6a"][0]
    assert (top.profile, top.confidence, top.evidence_class) == ("lte-s6a", "high", "protocol_strong_with_host_hints")
    assert top.reasons[0] == "aligned with suspected domain lte-eps"
    assert (got["naming"][0].confidence, got["naming"][0].evidence_class) == ("high", "protocol_strong")
    plain = {r.profile: r for r in got["dnsonly"]}["core-name-resolution"]
    assert (plain.confidence, plain.evidence_class) == ("low", "protocol_partial")
    assert all(r.profile != "5g-core" or r.reasons for rows in got.values() for r in rows)
    best = {r.capture_id: r.profile for r in ranking.best_profile(captures, ranking.recommended(scored)).collect()}
    assert best["lines"] == "lte-core" and best["s1"] == "lte-s1"


def test_signalling(captures):
    got = {}
    for r in domains.dominant_signalling(captures, primary_only=False).orderBy("capture_id", "rank").collect():
        got.setdefault(r.capture_id, []).append((r.protocol, r.strength, r.packets))
    assert len(got["many"]) == 10 and all(p != "sctp" for p, _, _ in got["many"])
    assert got["s6a"] == [("diameter", "strong", 200), ("sctp", "supporting", 200)]
    assert "lines" not in got
    context = {r.capture_id: r for r in domains.capture_context(captures).collect()}
    assert context["lines"].link_or_envelope_protocols == ["ip"] and context["lines"].transport_support_protocols == ["tcp"]
    relevant = [r.protocol for r in domains.relevant_signalling(captures).where("capture_id = 's6a'").orderBy("rank").collect()]
    assert relevant == ["diameter", "sctp"]


def test_enrichment(scored, captures):
    rows = {r.capture_id: r for r in enrichment.enrich(captures, ranking.recommended(scored, 6)).collect()}
    s6a = rows["s6a"]
    assert (s6a.trace_shape, s6a.classification_state) == ("single_domain", "confident")
    assert s6a.trace_shape_reasons == ["strong lte-eps signal, no competing domain"]
    voice = [c for c in s6a.candidates if c.profile.startswith("volte-diameter")]
    assert voice and all((c.confidence, c.evidence_class) == ("low", "downranked_protocol_match") for c in voice)
    assert s6a.next_step_hints == ["run: analyze <capture> --profile lte-s6a"]
    lines = rows["lines"]
    assert (lines.trace_shape, lines.classification_state) == ("transport_only", "unknown")
    assert lines.network_anomalies == ["transport-only trace: no application or signaling protocol decoded"]
    assert lines.next_step_hints == ["run discover to see if a protocol dissector override is needed"]
    assert rows["dnsonly"].classification_state == "ambiguous_support" and len(rows["dnsonly"].classification_notes) == 2
    assert rows["many"].trace_shape == "mixed_domain" and rows["many"].classification_state == "mixed"
    assert any("legacy protocol(s) present alongside modern signaling: map" in a for a in rows["many"].network_anomalies)
    assert rows["flat"].trace_shape == "single_domain" and "raw signaling hints" in rows["flat"].trace_shape_reasons[0]


def test_profile_catalogue():
    known = builtin_profiles()
    assert len(known) == 67
    assert known["lte-core"].layer_names("gtpv2") == ["gtpv2", "gtpv2-c", "gtp"] and known["lte-s11"].layer_names("gtpv2") == ["gtpv2", "gtpv2-c"]
    row = known["5g-n26"].selector_row()
    assert (row["family"], row["domain"], row["interface"], row["strong"], row["weak"]) == ("5g", "5g-sa-core", "n26", ["gtpv2", "http"], ["json", "udp"])
    union = discovery_profile(known.values())
    assert union.max_conversations == 50 and union.priority[:3] == ["bssap", "bssmap", "dtap"] and len(set(union.priority)) == len(union.priority)


def test_windows_over_profiles_move_nothing(spark, tmp_path, captures):
    captures.write.parquet(f"{tmp_path}/c")
    for rank in (ranking.recommended, ranking.suppressed):
        rows = rank(ranking.score_profiles(spark.read.parquet(f"{tmp_path}/c"), builtin_profiles().values()))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        first_expansion = plan.index("Generate inline(from_json") if "Generate inline(from_json" in plan else plan.index("Generate inline")
        assert plan.count("Exchange") - plan.count("AQEShuffleRead") == 1 and plan.index("Exchange") > first_expansion
