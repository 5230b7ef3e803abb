"""Registry of queries and their DuckDB checks, and text helpers for the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import oracle
from ..functions.link import LinkParams
from ..functions.numeric import col, round_half_up

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

# The link preset of the queries: 3.5 GHz, cellular class bounds.
PRESET = LinkParams(
    eirp_dbm=20.0,
    freq_mhz=3500.0,
    thresholds={"excellent": -85.0, "good": -95.0, "marginal": -105.0, "none": -110.0},
)


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register ``fn(spark, sf_dir)`` under a name, with its check SQL if it has one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql, recursive)
        return fn

    return add


# ---- Spark side -------------------------------------------------------------------


def r(c, digits: int = 4, name: str | None = None) -> Column:
    """Rounded output column."""
    label = name or (c if isinstance(c, str) else None)
    out = round_half_up(col(c), digits)
    return out.alias(label) if label else out


def big(c, name: str | None = None) -> Column:
    """Whole number or flag as BIGINT."""
    label = name or (c if isinstance(c, str) else None)
    out = col(c).cast("bigint")
    return out.alias(label) if label else out


def struct_out(df: DataFrame, key: str, c: Column, fields: dict, digits: int = 4) -> DataFrame:
    """Key and the rounded fields of a struct column."""
    return df.select(key, c.alias("_s")).select(
        key, *[r(F.col(f"_s.{f}"), digits, n) for f, n in fields.items()]
    )


# ---- SQL side ---------------------------------------------------------------------


def R(x: str, digits: int = 4) -> str:
    if digits == 0:
        return f"floor(({x}) + 0.5e0)"
    return f"floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits}"


def hav(la1: str, lo1: str, la2: str, lo2: str, radius: str = "6371008.8e0") -> str:
    return (
        f"(2 * {radius} * asin(sqrt("
        f"power(sin(radians(({la2}) - ({la1})) / 2), 2) + cos(radians({la1})) * cos(radians({la2}))"
        f" * power(sin(radians(({lo2}) - ({lo1})) / 2), 2))))"
    )


def fspl(d: str, mhz: str) -> str:
    return (
        f"(20 * log10(greatest({d}, 1e0)) + 20 * log10({mhz} * 1e6)"
        f" + 20 * log10(4 * pi() / 299792458e0))"
    )


def classes(dbm: str, bounds=("-85", "-95", "-105", "-110"), floor: str = "-120") -> str:
    e, g, m, n = bounds
    return (
        f"CASE WHEN {dbm} >= {e} THEN 0 WHEN {dbm} >= {g} THEN 1 WHEN {dbm} >= {m} THEN 2 "
        f"WHEN {dbm} >= {n} THEN 3 WHEN {dbm} >= {floor} THEN 4 END"
    )


def knife(v: str) -> str:
    return (
        f"(CASE WHEN {v} > -0.78e0 THEN 6.9e0 + 20 * log10(sqrt(power({v} - 0.1e0, 2) + 1)"
        f" + {v} - 0.1e0) ELSE 0e0 END)"
    )


def grid_elev(lng: str, lat: str) -> str:
    """Bilinear height of the fixture terrain, pixel centres, edges clamped, outside 0."""
    fx, fy = f"((({lng}) - 3.25e0) / 0.01e0 - 0.5e0)", f"((({lat}) - 50.75e0) / 0.01e0 - 0.5e0)"

    def px(x: str, y: str) -> str:
        return f"((16 - abs(({x} % 32) - 16)) * 12 + (10 - abs(({y} % 20) - 10)) * 9)"

    def edge(v: str, n: int) -> str:
        return f"CAST(greatest(0, least({n - 1}, floor({v}))) AS INT)"

    x0, y0 = edge(fx, 400), edge(fy, 280)
    x1, y1 = f"least(399, {x0} + 1)", f"least(279, {y0} + 1)"
    dx = f"greatest(0e0, least(1e0, {fx} - {x0}))"
    dy = f"greatest(0e0, least(1e0, {fy} - {y0}))"
    return (
        f"(CASE WHEN {fx} < -0.5e0 OR {fy} < -0.5e0 OR {fx} > 399.5e0 OR {fy} > 279.5e0 THEN 0e0 ELSE "
        f"{px(x0, y0)} * (1 - {dx}) * (1 - {dy}) + {px(x1, y0)} * {dx} * (1 - {dy}) + "
        f"{px(x0, y1)} * (1 - {dx}) * {dy} + {px(x1, y1)} * {dx} * {dy} END)"
    )
