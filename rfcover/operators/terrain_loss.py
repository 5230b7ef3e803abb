"""Path loss over terrain by ITU-R P.1812, as a batch job over a sample table.

A link's profile is one array. The public recommendation's terms are two passes over it
(horizons, smooth surface and Bullington extrema; the same on the smooth profile), then
scalars per link. Ducting is left out, as in the source material.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.link import knife_edge_db
from ..functions.numeric import clamp, dbl, square

# Fixed values of the recommendation.
EARTH_KM = 6371.0
LAND, SEA = (22.0, 0.003), (80.0, 5.0)  # relative permittivity, conductivity S/m
CLIMATES = ((25.0, 55.0, 355.0), (55.0, 45.0, 325.0), (91.0, 38.0, 310.0))  # |lat| below, dN, N0


def inverse_normal(x) -> Column:
    """Inverse complementary cumulative normal, 1e-6 <= x <= 1 - 1e-6."""
    x = clamp(dbl(x), F.lit(1e-6), F.lit(1 - 1e-6))
    t = F.sqrt(F.log(F.least(x, 1 - x)) * -2)
    top = (t * 0.010328 + 0.802853) * t + 2.515516698
    low = ((t * 0.001308 + 0.189269) * t + 1.432788) * t + 1
    v = t - top / low
    return F.when(x > 0.5, -v).otherwise(v)


def _ten(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def _bullington(slope_t, slope_r, v_los, hts, hrs, d, lam) -> Column:
    """Loss from the extrema of one profile."""
    direct = slope_t < (hrs - hts) / d
    db = (hrs - hts + slope_r * d) / (slope_t + slope_r)
    vb = (hts + slope_t * db - (hts * (d - db) + hrs * db) / d) * F.sqrt(d * 0.002 / (lam * db * (d - db)))
    edge = knife_edge_db(F.when(direct, v_los).otherwise(vb))
    return edge + (1 - F.exp(-edge / 6)) * (d * 0.02 + 10)


def _first_term_stage(df: DataFrame, prefix: str, radius: str, ht: str, hr: str, polarisation: str) -> DataFrame:
    """Add ``prefix``: the first-term loss over land and sea for a radius column."""
    f, d, a = F.col("f_ghz"), F.col("d_km"), F.col(radius)
    for tag, (eps, sigma) in (("_l", LAND), ("_s", SEA)):
        p = prefix + tag
        loss = square(F.lit(18 * sigma) / f)
        k = F.pow(a * f, -1 / 3) * 0.036 * F.pow(F.lit((eps - 1) ** 2) + loss, -0.25)
        if polarisation == "v":
            k = k * F.sqrt(F.lit(eps**2) + loss)
        df = df.withColumn(p + "k", k).withColumn(p + "k2", square(p + "k"))
        k2, k4 = F.col(p + "k2"), square(p + "k2")
        df = df.withColumn(p + "b", (k2 * 1.6 + k4 * 0.67 + 1) / (k2 * 4.5 + k4 * 1.53 + 1))
        b = F.col(p + "b")
        df = df.withColumn(p + "x", b * 21.88 * F.pow(f / square(radius), 1 / 3) * d)
        y = b * 0.9575 * F.pow(square(f) / a, 1 / 3)
        df = df.withColumn(p + "t", b * y * F.col(ht)).withColumn(p + "r", b * y * F.col(hr))
        x = F.col(p + "x")
        fx = F.when(x >= 1.6, F.log10(x) * 10 - x * 17.6 + 11).otherwise(F.log10(x) * -20 - F.pow(x, 1.425) * 5.6488)

        def gain(c):
            v = F.col(c)
            g = F.when(v > 2, F.sqrt(v - 1.1) * 17.6 - F.log10(v - 1.1) * 5 - 8).otherwise(F.log10(v + v * v * v * 0.1) * 20)
            return F.greatest(g, F.log10(F.col(p + "k")) * 20 + 2)

        df = df.withColumn(p, -fx - gain(p + "t") - gain(p + "r")).drop(*[p + s for s in ("k", "k2", "b", "x", "t", "r")])
    w = F.col("sea_frac")
    mixed = F.when(w <= 0, F.col(prefix + "_l")).otherwise(w * F.col(prefix + "_s") + (1 - w) * F.col(prefix + "_l"))
    return df.withColumn(prefix, mixed).drop(prefix + "_l", prefix + "_s")


def _spherical(df: DataFrame, out: str, radius: str, polarisation: str) -> DataFrame:
    """Add ``out``: spherical-earth loss for heights hts2, hrs2."""
    a, d, lam = F.col(radius), F.col("d_km"), F.col("lam")
    ht, hr = F.col("hts2"), F.col("hrs2")
    df = df.withColumn("_pt", F.greatest(ht, F.lit(0.1))).withColumn("_pr", F.greatest(hr, F.lit(0.1)))
    df = df.withColumn("_low", (ht <= 0) | (hr <= 0))
    df = df.withColumn("_ht", F.when(F.col("_low"), F.col("_pt")).otherwise(ht)).withColumn("_hr", F.when(F.col("_low"), F.col("_pr")).otherwise(hr))
    ht, hr = F.col("_ht"), F.col("_hr")
    df = _first_term_stage(df, "_far", radius, "_ht", "_hr", polarisation)
    df = df.withColumn("_dlos", F.sqrt(a * 2) * (F.sqrt(ht * 0.001) + F.sqrt(hr * 0.001)))
    df = df.withColumn("_m", square(d) * 250 / (a * (ht + hr))).withColumn("_c", (ht - hr) / (ht + hr))
    m = F.col("_m")
    arg = clamp(F.col("_c") * 1.5 * F.sqrt(m * 3 / ((m + 1) * (m + 1) * (m + 1))), F.lit(-1.0), F.lit(1.0))
    df = df.withColumn("_b", F.sqrt((m + 1) / (m * 3)) * 2 * F.cos(F.acos(arg) / 3 + math.pi / 3))
    df = df.withColumn("_d1", d / 2 * (F.col("_b") + 1)).withColumn("_d2", d - F.col("_d1"))
    d1, d2 = F.col("_d1"), F.col("_d2")
    df = df.withColumn("_hse", ((ht - square(d1) * 500 / a) * d2 + (hr - square(d2) * 500 / a) * d1) / d)
    df = df.withColumn("_need", F.sqrt(F.greatest(d1 * d2 * lam / d, F.lit(0.0))) * 17.456)
    df = df.withColumn("_aem", square(d / (F.sqrt(ht) + F.sqrt(hr))) * 500)
    df = _first_term_stage(df, "_near", "_aem", "_ht", "_hr", polarisation)
    near = F.when(F.col("_hse") > F.col("_need"), 0.0).when(F.col("_near") < 0, 0.0).otherwise(
        (1 - F.col("_hse") / F.col("_need")) * F.col("_near")
    )
    loss = F.when(F.col("_low") | (d >= F.col("_dlos")), F.col("_far")).otherwise(near)
    used = ("_pt", "_pr", "_low", "_ht", "_hr", "_far", "_dlos", "_m", "_c", "_b", "_d1", "_d2", "_hse", "_need", "_aem", "_near")
    return df.withColumn(out, loss).drop(*used)


def terminal_clutter_db(f_ghz, clutter_m, height_m) -> Column:
    """Loss of an antenna below its surrounding clutter."""
    rise = dbl(clutter_m) - dbl(height_m)
    theta = F.degrees(F.atan(rise / 27))
    v = F.sqrt(dbl(f_ghz)) * 0.342 * F.sqrt(rise * theta)
    return F.when((dbl(clutter_m) > 0) & (rise > 0), F.greatest(F.lit(0.0), knife_edge_db(v) - 6.03)).otherwise(0.0)


SAMPLE = "i", "dist_m", "terrain_m", "clutter_m"
LINK = "freq_mhz", "tx_height_m", "rx_height_m", "lat_deg"


def profile_arrays(profiles: DataFrame, by=("link_id",), keep=LINK) -> DataFrame:
    """One row per link: ``keep`` and ``samples``, its profile from end to end as one array.

    This is the only shuffle of samples; a profile has as many as its link has parts.
    """
    one = F.struct("i", (F.col("dist_m") / 1000).alias("d"), F.col("terrain_m").alias("h"), F.coalesce("clutter_m", F.lit(0.0)).alias("c"))
    return profiles.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("samples"), *[F.first(c).alias(c) for c in keep])


def path_loss_p1812(
    profiles: DataFrame, *, p: float = 50.0, p_loc: float = 50.0, polarisation: str = "v", sea_frac: float = 0.0,
    sigma_loc: float = 5.5, by=("link_id",), n_0: float | None = None, delta_n: float | None = None,
) -> DataFrame:
    """Basic transmission loss per link: by columns, loss_db and its parts.

    Profiles hold, per sample: the ``by`` columns, i (0..n), dist_m, terrain_m,
    clutter_m, and per link freq_mhz, tx_height_m, rx_height_m, lat_deg. Both ends are
    included; clutter at the ends counts only as terminal loss. Frequencies outside
    30..6000 MHz give a NULL loss. ``n_0`` and ``delta_n`` stand for the refractivity of the latitude.
    """
    out = link_loss_p1812(
        profile_arrays(profiles, by), by, p=p, p_loc=p_loc, polarisation=polarisation, sea_frac=sea_frac, sigma_loc=sigma_loc, n_0=n_0, delta_n=delta_n
    )
    return out.select(*by, *PARTS)


PARTS = "loss_db", "fspl_db", "diffraction_db", "troposcatter_db", "clutter_tx_db", "clutter_rx_db", "beta0", "theta_mrad", "field_strength_dbuv"


def link_loss_p1812(
    links: DataFrame, by, *, p: float = 50.0, p_loc: float = 50.0, polarisation: str = "v", sea_frac: float = 0.0, sigma_loc: float = 5.5,
    n_0: float | None = None, delta_n: float | None = None,
) -> DataFrame:
    """Add the columns ``PARTS`` to links that carry their ``samples`` (see :func:`profile_arrays`).

    ``by`` are the links' keys. Two passes over the samples, one over the profile and one over the
    smooth earth between the effective heights, give all sums and extrema. Samples are
    unfolded where their array lies, so they are not shuffled again, and what is joined are links.
    ``field_strength_dbuv`` is that of 1 kW radiated.
    """
    by = list(by)
    own = links.columns
    pp, pl, w = min(max(p, 1.0), 50.0), min(max(p_loc, 1.0), 99.0), min(max(sea_frac, 0.0), 1.0)
    lat = F.abs("lat_deg")
    d_n = F.lit(CLIMATES[2][1])
    n0 = F.lit(CLIMATES[2][2])
    for limit, dn, refraction in (CLIMATES[1], CLIMATES[0]):
        d_n, n0 = F.when(lat < limit, dn).otherwise(d_n), F.when(lat < limit, refraction).otherwise(n0)
    d_n = d_n if delta_n is None else F.lit(float(delta_n))
    n0 = n0 if n_0 is None else F.lit(float(n_0))
    first, last = F.get("samples", F.lit(0)), F.element_at("samples", -1)
    x = links.withColumns({
        "d_km": last["d"], "h_first": first["h"], "h_last": last["h"], "c_first": first["c"], "c_last": last["c"],
        "f_ghz": F.col("freq_mhz") / 1000, "n0": n0, "ae": F.lit(EARTH_KM * 157) / (F.lit(157.0) - d_n), "ab": F.lit(EARTH_KM * 3), "sea_frac": F.lit(w),
    })
    x = x.withColumns({
        "lam": F.lit(0.2998) / F.col("f_ghz"), "hts": F.col("h_first") + F.col("tx_height_m"), "hrs": F.col("h_last") + F.col("rx_height_m"),
    })
    radii = ["ae"] if pp >= 50 else ["ae", "ab"]
    dt, hts, hrs, ae = (F.col(c) for c in ("d_km", "hts", "hrs", "ae"))

    def extrema(hts, hrs, g, a):
        """Steepest slopes from both ends and the largest diffraction parameter."""
        d = F.col("d")
        top = g + d * (dt - d) * 500 / F.col(a)
        above = top - (hts * (dt - d) + hrs * d) / dt
        v = above * F.sqrt(dt * 0.002 / (F.col("lam") * d * (dt - d)))
        inner = F.col("inner")
        return {"st": F.max(F.when(inner, (top - hts) / d)), "sr": F.max(F.when(inner, (top - hrs) / (dt - d))), "v": F.max(F.when(inner, v))}

    # Pass 1: trapezoid sums, obstruction heights, horizons, Bullington on the profile.
    before = lambda k, part: F.get("samples", k - 1)[part]
    each = F.transform("samples", lambda s, k: F.struct(
        k.alias("k"), s["d"].alias("d"), s["h"].alias("h"), s["c"].alias("c"), F.when(k > 0, before(k, "d")).alias("d0"), F.when(k > 0, before(k, "h")).alias("h0")
    ))
    d, inner = F.col("d"), F.col("inner")
    j = x.select(*by, *[c for c in ("d_km", "lam", "hts", "hrs", *radii)], F.size("samples").alias("n"), F.inline(each))
    j = j.withColumn("inner", (F.col("k") > 0) & (F.col("k") < F.col("n") - 1))
    j = j.withColumn("g", F.col("h") + F.when(inner, F.col("c")).otherwise(0.0))
    g, step = F.col("g"), d - F.col("d0")
    hh = g - (hts * (dt - d) + hrs * d) / dt
    theta_t = F.atan((g - hts) / (d * 1000) - d / (ae * 2)) * 1000
    theta_r = F.atan((g - hrs) / ((dt - d) * 1000) - (dt - d) / (ae * 2)) * 1000
    order = -F.col("k")
    one = j.groupBy(*by).agg(
        *[v.alias(f"a_{k}_{a}") for a in radii for k, v in extrema(hts, hrs, g, a).items()],
        F.sum(step * (F.col("h") + F.col("h0"))).alias("v1"),
        F.sum(step * (F.col("h") * (d * 2 + F.col("d0")) + F.col("h0") * (d + F.col("d0") * 2))).alias("v2"),
        F.max(F.when(inner, hh)).alias("hobs"), F.max(F.when(inner, hh / d)).alias("aobt"), F.max(F.when(inner, hh / (dt - d))).alias("aobr"),
        F.max(F.when(inner, F.struct(theta_t.alias("v"), order.alias("o"), d.alias("d")))).alias("_tt"),
        F.max(F.when(inner, F.struct(theta_r.alias("v"), order.alias("o"), (dt - d).alias("d")))).alias("_tr"),
    )
    x = x.join(one, by).withColumns({k: F.col(f"_{v[:2]}.{'d' if v[2:] else 'v'}") for k, v in ((n, n) for n in ("tt", "ttd", "tr", "trd"))}).drop("_tt", "_tr")
    hst, hsr = (F.col("v1") * 2 * dt - F.col("v2")) / square(dt), (F.col("v2") - F.col("v1") * dt) / square(dt)
    both = F.col("aobt") + F.col("aobr")
    cut = F.when(F.col("hobs") > 0, F.col("hobs")).otherwise(0.0)
    x = x.withColumns({"hst": hst, "hsr": hsr})
    x = x.withColumns({
        "hts2": hts - F.least(F.col("hst") - F.when(cut > 0, cut * F.col("aobt") / both).otherwise(0.0), F.col("h_first")),
        "hrs2": hrs - F.least(F.col("hsr") - F.when(cut > 0, cut * F.col("aobr") / both).otherwise(0.0), F.col("h_last")),
    })

    # Pass 2: Bullington over the smooth earth with the effective heights.
    flat = x.select(*by, "d_km", "lam", *radii, "hts2", "hrs2", F.size("samples").alias("n"), F.posexplode("samples.d").alias("k", "d"))
    flat = flat.withColumn("inner", (F.col("k") > 0) & (F.col("k") < F.col("n") - 1))
    two = flat.groupBy(*by).agg(
        *[v.alias(f"s_{k}_{a}") for a in radii for k, v in extrema(F.col("hts2"), F.col("hrs2"), F.lit(0.0), a).items()]
    )
    x = x.join(two, by)

    # what follows needs no samples
    lam = F.col("lam")
    for a in radii:
        x = _spherical(x, f"sph_{a}", a, polarisation)
        x = x.withColumn(f"la_{a}", _bullington(F.col(f"a_st_{a}"), F.col(f"a_sr_{a}"), F.col(f"a_v_{a}"), hts, hrs, dt, lam))
        x = x.withColumn(f"ls_{a}", _bullington(F.col(f"s_st_{a}"), F.col(f"s_sr_{a}"), F.col(f"s_v_{a}"), F.col("hts2"), F.col("hrs2"), dt, lam))
        x = x.withColumn(f"ld_{a}", F.col(f"la_{a}") + F.greatest(F.col(f"sph_{a}") - F.col(f"ls_{a}"), F.lit(0.0)))
    dtm = dt * (1 - w)
    tau = 1 - F.exp(F.pow(dtm, 2.41) * -0.000412)
    x = x.withColumn("mu1", F.least(F.pow(_ten(-dtm / (F.lit(16.0) - tau * 6.6)) + _ten((tau * 0.354 + 0.496) * -5), 0.2), F.lit(1.0)))
    mu4 = F.when(lat <= 70, F.pow(F.col("mu1"), lat * 0.0176 - 0.935)).otherwise(F.pow(F.col("mu1"), 0.3))
    x = x.withColumn("beta0", F.when(lat <= 70, _ten(lat * -0.015 + 1.67)).otherwise(4.17) * F.col("mu1") * mu4)
    f = F.col("f_ghz")
    x = x.withColumn("lbfs", F.log10(f) * 20 + F.log10(F.sqrt(square(dt) + square((hts - hrs) / 1000))) * 20 + 92.4)
    td = F.atan((hrs - hts) / (dt * 1000) - dt / (ae * 2)) * 1000
    rd = F.atan((hts - hrs) / (dt * 1000) - dt / (ae * 2)) * 1000
    x = x.withColumn("_td", td).withColumn("_rd", rd)
    los = F.coalesce(F.col("tt") < F.col("_td"), F.lit(True))
    x = x.withColumn("_los", los)
    theta = dt * 1000 / ae + F.when(F.col("_los"), F.col("_td")).otherwise(F.col("tt")) + F.when(F.col("tr") >= F.col("_rd"), F.col("tr")).otherwise(F.col("_rd"))
    x = x.withColumn("theta_mrad", theta)
    reach = F.when(F.col("_los"), dt).otherwise(F.col("ttd") + F.col("trd"))
    efac = (1 - F.exp(reach * -0.1)) * 2.6
    x = x.withColumn("lb0p", F.col("lbfs") + efac * math.log10(pp / 50)).withColumn("lb0b", F.col("lbfs") + efac * F.log10(F.col("beta0") / 50))
    ratio = inverse_normal(F.lit(pp / 100)) / F.nullif(inverse_normal(F.col("beta0") / 100), F.lit(0.0))
    ld50 = F.col("ld_ae")
    if pp < 50:
        fi = F.when(F.lit(pp) > F.col("beta0"), ratio).otherwise(1.0)
        x = x.withColumn("ldp", ld50 + fi * (F.col("ld_ab") - ld50))
    else:
        x = x.withColumn("ldp", ld50)
    ldp, lbd50 = F.col("ldp"), F.col("lbfs") + ld50
    notional = F.when(F.lit(pp) < F.col("beta0"), F.col("lb0p") + ldp * (1 - w)).otherwise(
        lbd50 + (F.col("lb0b") + ldp * (1 - w) - lbd50) * ratio
    )
    x = x.withColumn("_lbd", F.col("lb0p") + ldp).withColumn("_min", notional)
    fj = 1 - (F.tanh((F.col("theta_mrad") - 0.3) * 8.0) + 1) * 0.5
    x = x.withColumn("_bam", F.col("_lbd") + (F.col("_min") - F.col("_lbd")) * fj)
    scatter = (
        F.log10(f) * 25 - square(F.log10(f / 2)) * 2.5 + F.log10(dt) * 20 + F.col("theta_mrad") * 0.573 - F.col("n0") * 0.15 + 190.1
        - 10.125 * max(0.0, math.log10(50 / pp)) ** 0.7
    )
    x = x.withColumn("troposcatter_db", scatter)
    x = x.withColumn("_lbc", F.log10(_ten(F.col("troposcatter_db") * -0.2) + _ten(F.col("_bam") * -0.2)) * -5)
    x = x.withColumn("clutter_tx_db", terminal_clutter_db(f, F.coalesce("c_first", F.lit(0.0)), "tx_height_m"))
    x = x.withColumn("clutter_rx_db", terminal_clutter_db(f, F.coalesce("c_last", F.lit(0.0)), "rx_height_m"))
    where = F.lit(0.0) if pl == 50 else inverse_normal(F.lit(pl / 100)) * -sigma_loc
    loss = F.greatest(F.col("lb0p"), F.col("_lbc") + F.col("clutter_tx_db") + F.col("clutter_rx_db")) + where
    known = F.col("freq_mhz").between(30, 6000) & (dt > 0)
    x = x.select(
        *own, F.when(known, loss).alias("loss_db"), F.col("lbfs").alias("fspl_db"),
        ldp.alias("diffraction_db"), "troposcatter_db", "clutter_tx_db", "clutter_rx_db", "beta0", "theta_mrad", F.col("f_ghz").alias("_f"),
    )
    return x.withColumn("field_strength_dbuv", F.log10("_f") * 20 + 199.36 - F.col("loss_db")).drop("_f")
