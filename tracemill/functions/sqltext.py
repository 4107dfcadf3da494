"""Helpers for expressions written as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def bound(value: str, name: str, use: str) -> str:
    """SQL ``use``, in which ``name`` stands for ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def select_once(df: DataFrame, *exprs: str) -> DataFrame:
    """``selectExpr`` whose expressions are evaluated once per row.

    A filter or an inferred null check on a plain projection is pushed below it, which repeats the
    expressions it mentions; behind a generator it stays where it is.  Plain columns are kept beside the
    generator, so that a filter on them still reaches the scan.
    """
    plain = {e.strip("`") for e in exprs if e.strip("`") in df.columns}
    named = [e if " as " in e else f"{e} as {e.strip('`').rsplit('.', 1)[-1]}" for e in exprs if e.strip("`") not in plain]
    outer = [f"`{e.strip('`')}`" if e.strip("`") in plain else e.rsplit(" as ", 1)[-1] if " as " in e else e.rsplit(".", 1)[-1] for e in exprs]
    if not named:
        return df.selectExpr(*outer)
    return df.selectExpr(*[f"`{c}`" for c in plain], f"inline(array(struct({', '.join(named)})))").selectExpr(*outer)


def sql_map(table: dict) -> str:
    """A constant SQL map."""
    show = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "\\'") + "'"
    return "map(" + ", ".join(f"{show(k)}, {show(v)}" for k, v in table.items()) + ")"
