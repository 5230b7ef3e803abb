"""Link-budget expressions: levels, losses, thresholds and classes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import EARTH_RADIUS_M
from .numeric import clamp, col, dbl, round_half_up, square

# Fixed values.
LIGHT_M_S = 299792458.0
EFFECTIVE_EARTH_M = EARTH_RADIUS_M * 4 / 3
TX_GAIN_DBI = 2.15
DEFAULT_FLOOR_DBM = -120.0
DEFAULT_THRESHOLDS = {"excellent": -85.0, "good": -95.0, "marginal": -103.0, "none": -110.0}
# Voice mode: excellent, good, marginal, none, floor.
MODE_THRESHOLDS = {
    "Analogue": (-85.0, -95.0, -103.0, -110.0, -120.0),
    "DMR": (-85.0, -98.0, -107.0, -108.0, -120.0),
    "P25": (-85.0, -98.0, -107.0, -108.0, -120.0),
    "dPMR": (-85.0, -100.0, -109.0, -110.0, -120.0),
}
_FSPL_CONST = 20 * math.log10(4 * math.pi / LIGHT_M_S)


@dataclass(frozen=True)
class LinkParams:
    """One link setting; any number may instead be a Column of the site or cell."""

    eirp_dbm: float | Column = 30.0
    freq_mhz: float | Column = 150.0
    rx_gain_dbi: float = 0.0
    clutter_db: float = 0.0
    rx_height_m: float = 1.5
    floor_dbm: float = DEFAULT_FLOOR_DBM
    thresholds: dict = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))


def watts_to_dbm(watts) -> Column:
    w = dbl(watts)
    return F.when(w.isNotNull(), F.log10(F.greatest(w, F.lit(1e-9)) * 1000) * 10)


def dbm_to_watts(dbm) -> Column:
    return F.pow(F.lit(10.0), dbl(dbm) / 10) / 1000


def wavelength_m(freq_mhz) -> Column:
    return F.lit(LIGHT_M_S) / (dbl(freq_mhz) * 1e6)


def fspl_db(distance_m, freq_mhz) -> Column:
    d = dbl(distance_m)
    # At least 1 m. The sum keeps a missing distance missing (greatest() alone would
    # not) and names the distance only twice: filters on levels copy it as a formula.
    d = F.log10(d + F.greatest(1 - d, F.lit(0.0)))
    return d * 20 + F.log10(dbl(freq_mhz) * 1e6) * 20 + F.lit(_FSPL_CONST)


def received_dbm(
    distance_m, eirp_dbm, freq_mhz, rx_gain_dbi=0.0, diffraction_db=0.0, clutter_db=0.0
) -> Column:
    return (
        dbl(eirp_dbm)
        - fspl_db(distance_m, freq_mhz)
        + dbl(rx_gain_dbi)
        - dbl(diffraction_db)
        - dbl(clutter_db)
    )


def max_range_m(eirp_dbm, freq_mhz, rx_gain_dbi=0.0, floor_dbm=DEFAULT_FLOOR_DBM) -> Column:
    """Distance at which free space alone brings the level down to the floor."""
    budget = (
        dbl(eirp_dbm)
        + dbl(rx_gain_dbi)
        - dbl(floor_dbm)
        - F.log10(dbl(freq_mhz) * 1e6) * 20
        - F.lit(_FSPL_CONST)
    )
    return F.pow(F.lit(10.0), budget / 20)


def earth_bulge_m(d1, d2) -> Column:
    return col(d1) * col(d2) / F.lit(2 * EFFECTIVE_EARTH_M)


def knife_edge_db(v) -> Column:
    """Single knife-edge loss; zero when there is no edge or v <= -0.78."""
    v = col(v)
    loss = F.log10(F.sqrt(square(v - 0.1) + 1) + v - 0.1) * 20 + 6.9
    return F.when(v > -0.78, loss).otherwise(F.lit(0.0))


def fresnel_v(clearance_m, d1, d2, freq_mhz) -> Column:
    """Diffraction parameter of an edge ``clearance_m`` above the sight line."""
    d1, d2 = col(d1), col(d2)
    return col(clearance_m) * F.sqrt((d1 + d2) * 2 / (wavelength_m(freq_mhz) * d1 * d2))


def fresnel_radius_m(d1, d2, freq_mhz) -> Column:
    d1, d2 = col(d1), col(d2)
    r = F.sqrt(wavelength_m(freq_mhz) * d1 * d2 / F.nullif(d1 + d2, F.lit(0.0)))
    return F.when((d1 > 0) & (d2 > 0), r).otherwise(F.lit(0.0))


def classify_dbm(dbm, thresholds=None, floor_dbm=DEFAULT_FLOOR_DBM) -> Column:
    """0 excellent .. 4 none; NULL below the floor or without a level."""
    t = thresholds or DEFAULT_THRESHOLDS
    v = col(dbm)
    return (
        F.when(v >= dbl(t["excellent"]), 0)
        .when(v >= dbl(t["good"]), 1)
        .when(v >= dbl(t["marginal"]), 2)
        .when(v >= dbl(t["none"]), 3)
        .when(v >= dbl(floor_dbm), 4)
    )


def quarter_db(margin_db) -> Column:
    """Margin in whole quarter decibels, 0..254."""
    return clamp(round_half_up(col(margin_db) * 4), F.lit(0.0), F.lit(254.0))


def thresholds_from_sensitivity(sens_dbm, kind: str = "radio") -> Column:
    """Class bounds above a receiver's sensitivity; radios are rounded to 1 dB."""
    s = dbl(sens_dbm)
    if kind == "cellular":
        s = F.coalesce(s, F.lit(-110.0))
        steps = {"excellent": 25, "good": 15, "marginal": 5, "none": 0}
        return F.struct(*[(s + float(v)).alias(k) for k, v in steps.items()])
    steps = {"excellent": 25, "good": 15, "marginal": 7, "none": 0}
    return F.struct(*[round_half_up(s + float(v)).alias(k) for k, v in steps.items()])


def mode_thresholds(mode) -> Column:
    """Preset of a voice mode; unknown modes use Analogue."""
    names = ("excellent", "good", "marginal", "none", "floor")

    def preset(values):
        return F.struct(*[F.lit(v).alias(k) for k, v in zip(names, values)])

    out = preset(MODE_THRESHOLDS["Analogue"])
    for name, values in MODE_THRESHOLDS.items():
        out = F.when(col(mode) == name, preset(values)).otherwise(out)
    return out
