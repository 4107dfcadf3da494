"""Lookup files: hosts, node map, subnets, point codes, element types.

Readers keep the file order in ``ord`` because the last host and the first network win.  All of
them give plain DataFrames, so a lookup can as well come from a table.
"""

from __future__ import annotations

import warnings
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.addresses import address_bits, valid_network
from tracemill.functions.convert import BLANKS
from tracemill.functions.tables import ELEMENT_TYPES
from tracemill.sources.profiles import load_mapping

NODE_SCHEMA = (
    "ord bigint, ip string, hostname string, cidr string, alias string, role string, site string,"
    " labels map<string,string>, network_element_override string"
)
NODE_KEYS = {"ip", "hostname", "alias", "role", "site", "cidr"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, line)`` without blank lines and ``#`` comments."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("ord", "line"))
    lines = lines.select("ord", F.trim(F.col("line"), F.lit(BLANKS)).alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def parse_hosts(lines: DataFrame) -> DataFrame:
    words = F.split("line", r"\s+")
    return lines.where(F.size(words) >= 2).select("ord", words[0].alias("ip"), words[1].alias("hostname"))


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, ip, hostname)``; words after the second are ignored."""
    return parse_hosts(numbered_lines(spark, path))


def _two_columns(lines: DataFrame) -> DataFrame:
    """First word and the rest of the line; lines with one word are dropped."""
    cut = F.split("line", r"\s+", 2)
    return lines.where(F.size(cut) == 2).select("ord", cut[0].alias("key"), cut[1].alias("alias"))


def parse_subnets(lines: DataFrame) -> DataFrame:
    out = _two_columns(lines).withColumnRenamed("key", "cidr")
    return out.where(valid_network("cidr"))


def read_subnets(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, cidr, alias)``; lines with an invalid network are dropped."""
    return parse_subnets(numbered_lines(spark, path))


def parse_point_codes(lines: DataFrame) -> DataFrame:
    return _two_columns(lines).select("ord", F.upper("key").alias("point_code"), "alias")


def read_point_codes(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, point_code, alias)``, codes in upper case."""
    return parse_point_codes(numbered_lines(spark, path))


def node_rows(nodes: list) -> list[tuple]:
    """Rows of the node map; keys other than the known ones become labels."""
    rows = []
    for place, node in enumerate(n for n in nodes if isinstance(n, dict)):
        labels = {
            str(k): v if isinstance(v, str) else json.dumps(v)
            for k, v in node.items()
            if k not in NODE_KEYS and v is not None
        }
        known = [None if node.get(k) in (None, "") else str(node[k]) for k in ("ip", "hostname", "cidr", "alias", "role", "site")]
        rows.append((place, *known, labels, labels.get("network_element_override")))
    return rows


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node map from a small YAML or JSON file with a ``nodes`` list."""
    return spark.createDataFrame(node_rows(load_mapping(path).get("nodes", [])), NODE_SCHEMA)


def check_element_types(rows: DataFrame) -> DataFrame:
    """Canonical element rows ``(ord, kind, value, element_type, problem)``; ``problem`` is null for good rows."""
    named = ", ".join(f"'{t.lower()}', '{t}'" for t in ELEMENT_TYPES)
    canonical = rows.selectExpr(
        "ord",
        "lower(trim(type)) as kind",
        "trim(value) as value",
        f"map({named})[lower(trim(network_element_type))] as element_type",
        "trim(network_element_type) as given",
    )
    problem = f"""case
        when kind is null or kind not in ('ip', 'subnet') then concat('invalid type: ', coalesce(kind, ''))
        when value is null or value = '' then 'missing value'
        when element_type is null then concat('unsupported element type: ', coalesce(given, ''))
        when kind = 'ip' and {address_bits("value")} is null then concat('invalid address: ', value)
        when kind = 'subnet' and not {valid_network("value")} then concat('invalid network: ', value)
    end as problem"""
    return canonical.selectExpr("ord", "kind", "value", "element_type", problem)


def read_element_types(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``(ord, kind, value, element_type)`` from a CSV.  A bad row rejects the file.

    ``strict`` raises then; otherwise the file counts as empty and a warning says why, so that a run goes on without it.
    """
    try:
        return _element_types(spark, path)
    except ValueError as problem:
        if strict:
            raise
        warnings.warn(f"{path} is left out: {problem}", stacklevel=2)
        return spark.createDataFrame([], "ord int, kind string, value string, element_type string")


def _element_types(spark: SparkSession, path: str) -> DataFrame:
    header = "type,value,network_element_type"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("ord", "line"))
    first = lines.where("ord = 0").select(F.sort_array(F.split("line", ",")).alias("names")).first()
    if first is None or list(first.names) != sorted(header.split(",")):
        raise ValueError(f"element types need the header {header}")
    names = lines.where("ord = 0").select(F.split("line", ",").alias("n")).first().n
    body = lines.where((F.col("ord") > 0) & (F.trim("line") != ""))
    parsed = body.select("ord", F.from_csv("line", F.lit(", ".join(f"`{n}` string" for n in names))).alias("r"))
    checked = check_element_types(parsed.select("ord", "r.*"))
    bad = checked.where("problem is not null").orderBy("ord").first()
    if bad is not None:
        raise ValueError(f"element types, line {bad.ord + 1}: {bad.problem}")
    return checked.drop("problem")
