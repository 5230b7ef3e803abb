"""Sun position and HF frequency windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, dbl, fixed

# Assessed bands (MHz) and smoothed sunspot numbers.
HF_BANDS = (
    ("3 MHz (90m)", 2.3, 3.5), ("5 MHz (60m)", 4.75, 5.45), ("7 MHz (40m)", 6.8, 7.3), ("10 MHz (30m)", 9.5, 10.1),
    ("14 MHz (20m)", 13.5, 14.5), ("18 MHz (17m)", 17.9, 18.2), ("21 MHz (15m)", 20.5, 21.5), ("28 MHz (10m)", 27.5, 29.7),
)
SUNSPOTS = {"low": 30.0, "medium": 100.0, "high": 180.0}


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def with_solar_position(df: DataFrame, ts="ts", lat="lat", lng="lng") -> DataFrame:
    """Add zenith, altitude and azimuth (degrees). ``ts`` is UTC; built in steps so that
    each stage is computed once."""
    t = col(ts)
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date"))
    micros = F.date_format(t, "SSSSSS").cast("double") / 1e6
    n = days + (seconds + F.floor(micros * 1000) / 1000) / 86400 + 2440587.5 - 2451545.0
    out = df.withColumn("_n", n).withColumn("_h", seconds / 3600)
    out = out.withColumn("_g", F.radians(F.pmod(F.col("_n") * 0.9856003 + 357.528, F.lit(360.0))))
    mean = F.pmod(F.col("_n") * 0.9856474 + 280.46, F.lit(360.0))
    out = out.withColumn("_lam", F.radians(mean + F.sin("_g") * 1.915 + F.sin(F.col("_g") * 2) * 0.02))
    out = out.withColumn("_eps", F.radians(F.lit(23.439) - F.col("_n") * 4e-7))
    out = out.withColumn("_dec", F.asin(_unit(F.sin("_eps") * F.sin("_lam"))))
    ra = F.degrees(F.atan2(F.cos("_eps") * F.sin("_lam"), F.cos("_lam")))
    out = out.withColumn("_ra", F.when(ra < 0, ra + 360).otherwise(ra))
    sidereal = F.pmod(F.col("_n") * 0.0657098242 + 6.697375 + F.col("_h"), F.lit(24.0))
    # The remainder keeps the sign of its dividend.
    out = out.withColumn("_ha", F.radians((sidereal + col(lng) / 15 - F.col("_ra") / 15 + 24) % 24 * 15))
    phi = F.radians(col(lat))
    out = out.withColumn(
        "_sin", F.sin(phi) * F.sin("_dec") + F.cos(phi) * F.cos("_dec") * F.cos("_ha")
    ).withColumn("altitude", F.degrees(F.asin(_unit(F.col("_sin")))))
    rise = F.cos(F.radians("altitude"))
    cos_az = (F.sin("_dec") - F.sin(phi) * F.col("_sin")) / F.nullif(F.cos(phi) * rise, F.lit(0.0))
    az = F.degrees(F.acos(_unit(cos_az)))
    az = F.when(F.sin("_ha") > 0, F.lit(360.0) - az).otherwise(az)
    return (
        out.withColumn("azimuth", F.when(rise > 1e-10, az).otherwise(0.0))
        .withColumn("zenith", F.lit(90.0) - F.col("altitude"))
        .drop("_n", "_h", "_g", "_lam", "_eps", "_dec", "_ra", "_ha", "_sin")
    )


def hf_conditions(df: DataFrame, ts="ts", lat="lat", lng="lng", path_km="path_km", cycle="solar_cycle") -> DataFrame:
    """Critical, maximum, lowest and working frequency, propagation mode and season."""
    out = with_solar_position(df, ts, lat, lng)
    ssn = F.lit(SUNSPOTS["medium"])
    for name, v in SUNSPOTS.items():
        ssn = F.when(col(cycle) == name, v).otherwise(ssn)
    month = F.month(col(ts))
    summer = F.when(col(lat) >= 0, month.between(5, 9)).otherwise((month < 3) | (month > 10))
    out = out.withColumn("_path", F.greatest(F.lit(0.0), F.coalesce(dbl(path_km), F.lit(0.0))))
    out = out.withColumn("_flux", ssn * 0.728 + 63)
    out = out.withColumn("_day", F.greatest(F.lit(0.0), F.cos(F.radians("zenith"))))
    day, night = F.col("_flux") * 0.02 + 4.5, F.col("_flux") * 0.008 + 2.5
    out = out.withColumn("season", F.when(summer, "summer").otherwise("winter"))
    out = out.withColumn(
        "fo_f2",
        (day * F.col("_day") + night * (1 - F.col("_day"))) * (1 - F.abs(col(lat)) * 0.004)
        * F.when(F.col("season") == "summer", 1.1).otherwise(0.88),
    )
    p = F.col("_path")
    oblique = F.when(p <= 300, 1.1).when(p <= 1500, (p - 300) / 1200 * 1.9 + 1.1).otherwise(p / 5000 + 3.0)
    sunlit = F.col("zenith") < 90
    out = out.withColumn("muf", F.least(F.lit(30.0), F.col("fo_f2") * oblique))
    out = out.withColumn(
        "luf", F.when(sunlit, F.col("_day") * 0.5 * (F.col("_flux") / 80) + p / 2000 + 1.5).otherwise(1.0)
    )
    out = out.withColumn("ouf", F.col("muf") * 0.85)
    out = out.withColumn("nvis_viable", (F.col("fo_f2") > F.col("luf")) & (p <= 500)).withColumn("night_absorb", ~sunlit)
    any_open = F.lit(False)
    for _, lo, hi in HF_BANDS:
        any_open = any_open | ~((F.lit(hi) < F.col("luf")) | (F.lit(lo) >= F.col("muf")))
    sky = any_open & (p > 300) & (F.col("muf") > F.col("luf"))
    nvis = F.col("nvis_viable")
    mode = F.when(nvis & sky, "both").when(nvis, "nvis").when(sky, "skywave").otherwise("none")
    return out.withColumn("any_open", any_open).withColumn("mode", mode).drop("_path", "_flux", "_day")


def hf_bands(conditions: DataFrame, keep=()) -> DataFrame:
    """Eight rows per condition: viable, marginal or no, with the reason."""
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(lo).alias("f_low"), F.lit(hi).alias("f_high")) for b, lo, hi in HF_BANDS])
    c = conditions.select(*keep, "muf", "luf", F.inline(rows))
    lo, hi, muf, luf = F.col("f_low"), F.col("f_high"), F.col("muf"), F.col("luf")
    closed = (hi < luf) | (lo >= muf)
    viable = (lo > luf) & (hi <= muf)

    def at(text, v):
        return F.concat(F.lit(text), F.lit(" ("), fixed(v, 1), F.lit(")"))

    reason = (
        F.when(closed & (lo >= muf), at("above MUF", muf)).when(closed, at("below LUF", luf))
        .when(viable, "within LUF–MUF window").when(hi > muf, at("upper edge above MUF", muf))
        .otherwise(at("lower edge near LUF", luf))
    )
    status = F.when(closed, "no").when(viable, "viable").otherwise("marginal")
    return c.select(*keep, "band", "f_low", "f_high", status.alias("status"), reason.alias("reason"))
