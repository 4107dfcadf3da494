"""Protocol classification of index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.tables import TRANSPORT_FALLBACK
from tracemill.sources.profiles import Profile


def top_protocol(stack: str, profile: Profile) -> str:
    """SQL text: first protocol of the profile's priority with an alias in ``stack``, else the transport.

    ``stack`` holds the protocol stack and, where known, the layer names.
    """
    candidates = [(name, profile.layer_names(name)) for name in profile.priority]
    candidates += [("ip" if name == "ipv6" else name, [name]) for name in TRANSPORT_FALLBACK]
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    cases = " ".join(f"when arrays_overlap({stack}, array({listed(names)})) then '{name}'" for name, names in candidates)
    return f"case {cases} else 'unknown' end"


def with_top_protocol(df: DataFrame, profile: Profile, stack: str = "protocols") -> DataFrame:
    return df.withColumn("top_protocol", F.expr(top_protocol(stack, profile)))
