"""Classification and protection of leaves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions.tables import PRIVACY_PROFILES
from tracemill.operators import privacy as pv


def classes(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, path string, value string, protocol string, is_text boolean")
    out = pv.classify_leaves(df, protocol="protocol", is_text="is_text")
    return [r.data_class for r in out.orderBy("n").collect()]


def test_classes(spark):
    rows = [
        ("message.fields.diameter.origin_host", "x", "diameter", True), ("message.fields.diameter.user_name", "x", "diameter", True),
        ("message.fields.gtpv2.apn", "x", "gtpv2", True), ("message.fields.http2.header.:path", "x", "http2", True),
        ("src.ip", "x", "", True), ("a.b", "at 10.0.0.1 now", "", True), ("a.b", "fe80:1:2::", "", True), ("a.b", "2001:db8:0:1:2:3:4:5", "", True),
        ("a.hostname", "x", "", True), ("a.b", "mail bob@example.org", "", True), ("a.b", "Bearer abc.def", "", True),
        ("a.b", "see HTTPS://x", "", True), ("a.b", "call 0123456789 now", "", True), ("a.b", "x0123456789", "", True),
        ("a.b", "0123456789", "", False), ("a.b", "the IMSI", "", True), ("privacy.modes.ip", "10.0.0.1", "", True),
        ("a.security", "x", "", True), ("dns.count", "1", "", True), ("a.issuer", "x", "", True), ("a.ueid", "x", "", True), ("a.b", "plain", "", True),
    ]
    assert classes(spark, rows) == [
        "diameter_identity", "subscriber_id", "apn_dnn", "uri", "ip", "ip", "ip", "ip", "hostname", "email", "token", "uri",
        "payload_text", None, None, "payload_text", None, "uri", "hostname", "distinguished_name", "subscriber_id", None,
    ]


def protect(spark, rows, modes, **more):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, data_class string, value string")
    return {r.n: r.protected for r in pv.protect_leaves(df, modes, **more).collect()}


def test_known_pseudonym(spark):
    got = protect(spark, [("imsi", "001010123456789"), ("imsi", "001010123456789"), ("ip", "1.1.1.1")], {"imsi": "pseudonymize", "ip": "remove"})
    assert got == {0: "IMSI_da49ae5e", 1: "IMSI_da49ae5e"}


def test_partial_modes(spark):
    modes = {"imsi": "keep_mcc_mnc_mask_msin", "msisdn": "keep_cc_ndc_pseudonymize_subscriber", "imei": "keep_tac_mask_serial", "uri": "keep_tac_mask_serial"}
    rows = [
        ("imsi", "262011234567890"), ("imsi", "310410123456789"), ("imsi", "12345"), ("imsi", "2620112345678901"),
        ("msisdn", "+491701234567"), ("msisdn", "12025550123"), ("msisdn", "4915112345678"), ("msisdn", "abc"), ("msisdn", "1234"),
        ("imei", "356938035643809"), ("imei", "12345678"), ("uri", "x"), ("email", "kept"),
    ]
    alias = lambda prefix, rest: "MSISDN_SUFFIX_" + hashlib.blake2s(f"msisdn_suffix:{prefix}:{rest}".encode(), digest_size=4).hexdigest()
    assert protect(spark, rows, modes) == {
        0: "26201XXXXXXXXXX (Germany)", 1: "310410XXXXXXXXX (United States of America)", 2: "[redacted]", 3: "[redacted]",
        4: f"+49170{alias('+49170', '1234567')} (Germany)", 5: f"1{alias('1', '2025550123')}", 6: f"4915{alias('4915', '112345678')} (Germany)",
        7: "[redacted]", 8: "[redacted]", 9: "35693803XXXXXXX", 10: "[redacted]", 11: "[redacted]", 12: "kept",
    }


def test_numbering_hints(spark):
    numbering = pv.Numbering(imsi_mnc_lengths={"262": 3}, msisdn_ndc_lengths={"44": 4}, msisdn_ndc_prefixes={"33": ["6", "61"]})
    rows = [("imsi", "262011234567890"), ("msisdn", "447911123456"), ("msisdn", "33612345678"), ("msisdn", "33712345678")]
    modes = {"imsi": "keep_mcc_mnc_mask_msin", "msisdn": "keep_cc_ndc_mask_subscriber"}
    assert protect(spark, rows, modes, numbering=numbering) == {
        0: "262011XXXXXXXXX (Germany)", 1: "447911XXXXXX", 2: "3361XXXXXXX", 3: "33XXXXXXXXX",
    }


def test_lists_keep_their_shape(spark):
    df = spark.createDataFrame(
        [(1, [("src.ip", "1.1.1.1", True), ("note", "hello", True), ("imsi", "262011234567890", True), ("token", "t", True)]), (2, []), (3, None)],
        "n int, leaves array<struct<path:string,value:string,is_text:boolean>>",
    )
    modes = {"ip": "pseudonymize", "imsi": "keep_mcc_mnc_pseudonymize_msin", "token": "remove"}
    got = {r.n: r.leaves for r in pv.protect_leaf_lists(df, "leaves", modes).collect()}
    digest = lambda text: hashlib.blake2s(text.encode(), digest_size=4).hexdigest()
    assert [tuple(x) for x in got[1]] == [
        ("src.ip", "IP_" + digest("ip:1.1.1.1"), True), ("note", "hello", True),
        ("imsi", f"26201IMSI_SUFFIX_{digest('imsi_suffix:26201:1234567890')} (Germany)", True),
    ]
    assert not got[2] and not got[3]


def test_checks_before_the_run():
    pv.check_modes(PRIVACY_PROFILES["share"])
    with pytest.raises(ValueError):
        pv.check_modes({"imsi": "encrypt"})
    with pytest.raises(ValueError):
        pv.check_modes({"imsi": "keep_mcc_mnc_encrypt_msin"}, "short")
    with pytest.raises(ValueError):
        pv.check_modes({"imsi": "shred"})


def test_audit_and_encryption(spark):
    df = spark.createDataFrame([("ip", "a"), ("ip", "a"), ("ip", "b"), ("uri", "u")], "data_class string, value string")
    mapping = pv.pseudonym_map(df, {"ip": "pseudonymize", "uri": "mask"})
    assert [(r.data_class, r.originals) for r in pv.pseudonym_audit(mapping).collect()] == [("ip", 2)]
    assert pv.pseudonym_collisions(mapping).count() == 0
    out = pv.protect_leaves(df, {"ip": "encrypt"}, key=F.lit("0123456789abcdef")).where("data_class = 'ip'")
    plain = out.selectExpr("cast(aes_decrypt(unbase64(protected), '0123456789abcdef', 'GCM') as string) as p")
    assert sorted(r.p for r in plain.collect()) == ["a", "a", "b"]


@pytest.mark.parametrize("depth", [3, 14, 40])
def test_depth_changes_nothing(spark, depth):
    import json

    from tracemill.sources import packets as ps

    tree = {"note": "call 26201012345678 now", "imsi": ["262011234567890", {"deep": "10.0.0.1"}]}
    for _ in range(depth):
        tree = {"x": tree}
    df = spark.createDataFrame([("c", json.dumps(tree))], "capture_id string, layers string")
    rows = pv.protect_leaf_lists(ps.with_leaves(df), "leaves", PRIVACY_PROFILES["share"], report="report").collect()
    values = [l.value for l in rows[0].leaves]
    assert values[0] == "[redacted]" and values[1].startswith("IMSI_") and values[2].startswith("IP_") and len(values) == 3
    assert len(rows[0].report) == 3


def test_payloads_of_any_shape(spark):
    rows = spark.createDataFrame(
        [("10.0.0.9", "to 10.0.0.1", ["10.0.0.1", "x"], {"k": "10.0.0.1", "mail": "a@b.org"}, [("10.0.0.1", 3), (None, 4)], ("10.0.0.1", 7), {"ip": "10.0.0.1"}), ("d",) + (None,) * 6],
        "capture_id string, t string, l array<string>, m map<string,string>, s array<struct<src:string,n:int>>, o struct<a:string,b:int>, privacy_modes map<string,string>",
    )
    got = {r.capture_id: r for r in pv.protect_payload(rows, {"ip": "pseudonymize", "email": "remove"}, report="report").collect()}
    alias = lambda text: "IP_" + hashlib.blake2s(f"ip:{text}".encode(), digest_size=4).hexdigest()
    one = got["10.0.0.9"]
    assert one.t == alias("to 10.0.0.1") and one.l == [alias("10.0.0.1"), "x"] and one.m == {"k": alias("10.0.0.1")}
    assert [tuple(x) for x in one.s] == [(alias("10.0.0.1"), 3), (None, 4)] and tuple(one.o) == (alias("10.0.0.1"), 7)
    assert one.privacy_modes == {"ip": "10.0.0.1"}
    assert {(r.issued_class, r.original) for r in one.report if r.alias} == {("ip", "10.0.0.1"), ("ip", "to 10.0.0.1")}
    assert tuple(got["d"])[:-1] == ("d",) + (None,) * 6 and got["d"].report == []
    assert pv.protect_payload(rows.select("capture_id"), {"ip": "mask"}).columns == ["capture_id"]


def test_gates_lose_no_match(spark):
    rng = random.Random(3)
    parts = ["1", "25", "255", ".", ":", "af", "AF", "::", "\u0661", "\u06f3", " ", "@", "a.bc", "http://", "HTTP\u017f://", "\u017fip:", "Tel:", "WWW.", "www", "cook\u0131e", "COOKIE", "coo\u212aie",
             "bearer x", "BEARER", "10.0.0.1", "123456789012345", "e@x.org", "a:b:c", "author\u0130zation", "token=", "1234567890", "\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669\u0660", "+49", "\U0001d7ce", "x", "\n"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(6000)] + [None, ""]
    rows = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", "lower(v) as lowered")
    for name, pattern in pv.VALUE_PATTERNS.items():
        both = rows.selectExpr(f"{pv.matches('v', name)} as gated", f"v rlike r'{pattern}' as plain")
        assert both.where("coalesce(gated, false) <> coalesce(plain, false)").count() == 0
        assert both.where("plain").count() > 20


def test_classes_of_fixed_paths_equal_those_of_any_path(spark):
    values = ["10.0.0.1", "fe80:1:2::", "bob@x.org", "Bearer abc", "tel:1", "\u017fip:1", "0123456789", "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669", "012345678", "the imsi", "plain", "", None]
    df = spark.createDataFrame([(v, p) for v in values for p in ("diameter", "http2", "")], "v string, p string")
    paths = [*pv.PACKET_TEXTS, *pv.PACKET_LISTS, "privacy.modes.x", "a.APN", "diameter.user_name"]
    both = [F.expr(pv.data_class(p, "v", "p", fixed=True)).eqNullSafe(F.expr(pv.data_class(f"'{p}'", "v", "p"))) for p in paths]
    assert df.select(F.array(*both).alias("same")).where("not forall(same, s -> s)").count() == 0
    assert "contains(q" not in pv.data_class("src.ip", "v", "p", fixed=True)
