"""Radios, roles, band mix, plans, power, capacity, HF, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame, sql
from ..functions.numeric import number_text
from ..operators import hf as H
from ..operators import pace as PA
from ..operators import power as PW
from ..operators import radios as RD
from ..operators import search as S
from ..operators.runtime import cut_lineage
from .registry import R, big, query, r

_RAW = """
SELECT CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'p' || p_partkey END AS id, p_name AS label, CASE WHEN p_size % 11 = 0 THEN 'other' ELSE f.role END AS role,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 30e0 + p_size END AS freq_lo, CASE WHEN p_partkey % 4 = 0 THEN 0e0 ELSE 90e0 + p_size * 3 END AS freq_hi,
 CASE WHEN p_partkey % 6 < 4 THEN NULL ELSE f.default_freq_mhz END AS default_freq_mhz, CASE WHEN p_partkey % 7 = 1 THEN NULL ELSE f.power_w END AS power_w,
 CASE p_partkey % 5 WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN '-5' ELSE CAST(p_size * 25 AS VARCHAR(20)) END AS price, p_brand AS notes
FROM {part} JOIN {fx_radios} f ON f.radio_id = p_partkey"""
_ROLE_SQL = ", ".join(f"('{k}', {h}e0, {g}e0, {s}e0)" for k, (h, g, s) in RD.ROLE_DEFAULTS.items())
NORM_SQL = f"""
raw AS ({_RAW.strip()}), rd AS (SELECT * FROM (VALUES {_ROLE_SQL}) AS t(k, h, g, s)),
n AS (SELECT raw.*, coalesce(rd.k, 'handheld') AS nrole, coalesce(h, 1.5e0) AS h, coalesce(g, 2.15e0) AS g, coalesce(s, -116e0) AS s,
 coalesce(freq_lo, 0e0) AS lo, coalesce(freq_hi, 0e0) AS hi FROM raw LEFT JOIN rd ON rd.k = raw.role),
norm AS (SELECT id, label, nrole AS role, lo AS freq_lo, hi AS freq_hi, coalesce(nullif(default_freq_mhz, 0), CASE WHEN lo <> 0 AND hi <> 0 THEN (lo + hi) / 2 END, nullif(lo, 0), 150e0) AS default_freq_mhz,
 coalesce(power_w, 5e0) AS power_w, s AS rx_sens_dbm, g AS antenna_gain_dbi, h AS default_height_m, CASE WHEN TRY_CAST(nullif(price, '') AS DOUBLE) >= 0 THEN TRY_CAST(price AS DOUBLE) END AS price, notes FROM n)"""


def catalog(spark, d):
    return RD.normalize_radios(sql(spark, d, _RAW))


@query("normalize_radios", f"""
WITH {NORM_SQL} SELECT coalesce(id, '-') AS id, label, role, freq_lo, freq_hi, default_freq_mhz, power_w, rx_sens_dbm, antenna_gain_dbi, default_height_m, price FROM norm""")
def normalize_radios(spark, d):
    out = catalog(spark, d).drop("source", "notes")
    return out.withColumn("id", F.when(F.startswith("id", F.lit("p")), F.col("id")).otherwise("-"))


@query("overlay_catalog", """
WITH u AS (SELECT radio_id, label || ' (mine)' AS label FROM {fx_radios} WHERE power_w > 30)
SELECT radio_id, label FROM u UNION ALL SELECT radio_id, label FROM {fx_radios} WHERE radio_id NOT IN (SELECT radio_id FROM u)""")
def overlay_catalog(spark, d):
    base = frame(spark, d, "fx_radios").select("radio_id", "label", "power_w")
    mine = base.where("power_w > 30").withColumn("label", F.concat("label", F.lit(" (mine)")))
    return RD.overlay_catalog(base, mine, "radio_id").select("radio_id", "label")


_BAND = "CASE WHEN role = 'hf' THEN 'HF' WHEN role = 'lora' THEN 'LoRa' WHEN role = 'satcom' THEN 'Satcom' WHEN default_freq_mhz < 30 THEN 'HF' WHEN default_freq_mhz < 300 THEN 'VHF' WHEN default_freq_mhz < 1000 THEN 'UHF' ELSE 'SHF' END"


@query("search_radios", f"""
SELECT radio_id, label FROM {{fx_radios}} WHERE contains(lower(label), 'hf') OR contains(role, 'hf') OR contains(lower({_BAND}), 'hf')""")
def search_radios(spark, d):
    return RD.search_radios(frame(spark, d, "fx_radios"), " HF ").select("radio_id", "label")


@query("active_arsenal", """
SELECT DISTINCT mission_id, radio_id, label FROM {fx_arsenal} WHERE radio_id NOT IN (SELECT radio_id FROM {fx_radios} WHERE price IS NULL)""")
def active_arsenal(spark, d):
    a = frame(spark, d, "fx_arsenal").select("mission_id", "radio_id", "label", "price")
    twice = a.unionByName(a).drop("price")
    return RD.active_arsenal(twice, a.where("price IS NULL"), ("mission_id", "radio_id"))


_PAIRS = """
SELECT 'pair ' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'p' || (s_suppkey * 7 + 1) END AS infra_id, CASE WHEN s_suppkey % 6 = 1 THEN NULL ELSE 'p' || (s_suppkey * 3 + 2) END AS field_id FROM {supplier}"""
_PAIR_SQL = f"""
{NORM_SQL.strip()}, pr AS ({_PAIRS.strip()}), nn AS (SELECT * FROM norm WHERE id IS NOT NULL),
j AS (SELECT pr.name, a.id AS a_id, b.id AS b_id, a.label AS a_label, b.label AS b_label, coalesce(a.default_freq_mhz, b.default_freq_mhz) AS freq_mhz, coalesce(a.power_w, b.power_w) AS power_w,
 coalesce(a.default_height_m, b.default_height_m) AS tx_height_m, coalesce(b.default_height_m, a.default_height_m) AS rx_height_m, coalesce(b.rx_sens_dbm, a.rx_sens_dbm) AS sens, coalesce(a.role, b.role) AS tx_role
 FROM pr LEFT JOIN nn a ON a.id = pr.infra_id LEFT JOIN nn b ON b.id = pr.field_id)"""


@query("coverage_params", f"""
WITH {_PAIR_SQL}
SELECT name, freq_mhz, power_w, tx_height_m, rx_height_m, floor(sens + 25 + 0.5e0) AS excellent, floor(sens + 7 + 0.5e0) AS marginal, tx_role,
 CAST(tx_role NOT IN ('hf', 'satcom') AS BIGINT) AS raster_meaningful FROM j WHERE tx_role IS NOT NULL""")
def coverage_params(spark, d):
    out = RD.coverage_params(sql(spark, d, _PAIRS), catalog(spark, d))
    return out.select("name", "freq_mhz", "power_w", "tx_height_m", "rx_height_m", "excellent", "marginal", "tx_role", big("raster_meaningful"))


@query("structures", f"WITH {_PAIR_SQL} SELECT name, a_label AS infra_label, b_label AS field_label FROM j")
def structures(spark, d):
    out = RD.structures(sql(spark, d, _PAIRS), catalog(spark, d))
    return out.select("name", F.col("infra.label").alias("infra_label"), F.col("field.label").alias("field_label"))


@query("band_label", f"""
SELECT radio_id, CASE WHEN default_freq_mhz < 30 THEN 'HF' WHEN default_freq_mhz < 300 THEN 'VHF' WHEN default_freq_mhz < 1000 THEN 'UHF' WHEN default_freq_mhz < 3000 THEN 'L/S-band' ELSE 'SHF' END AS band, {_BAND} AS role_band FROM {{fx_radios}}""")
def band_label(spark, d):
    return frame(spark, d, "fx_radios").select("radio_id", RD.band_label("default_freq_mhz").alias("band"), RD.role_band_label().alias("role_band"))


def _five(x: str) -> str:
    return f"greatest(1e0, least(5e0, {x}))"


@query("radio_scores", f"""
WITH s AS (SELECT radio_id, label, power_w, radio_id % 70 / 10e0 AS kg, default_freq_mhz AS f FROM {{fx_radios}})
SELECT radio_id, {R(_five('greatest(500e0, least(50000e0, 6000e0 * CASE WHEN f < 30 THEN 4 WHEN f < 300 THEN 1 WHEN f < 1000 THEN 0.6e0 ELSE 0.3e0 END * sqrt(power_w / 5))) / 50000 * 5'))} AS range_score,
 {R(_five('power_w / 20 * 5'))} AS power_score, {R('CASE WHEN kg < 0.5 THEN 5e0 WHEN kg > 5 THEN 1e0 ELSE ' + _five('5 - (kg - 0.5e0) / 4.5e0 * 4') + ' END')} AS weight_score,
 CASE WHEN regexp_matches(label, '(?i)mil[- _]?(spec|std)|810|ip6[0-9]') THEN 5e0 ELSE 3e0 END AS ruggedness_score FROM s""")
def radio_scores(spark, d):
    s = frame(spark, d, "fx_radios").withColumn("weight_kg", F.col("radio_id") % 70 / 10)
    return RD.radio_scores(s, "radio_id").select("radio_id", r("range_score"), r("power_score"), r("weight_score"), "ruggedness_score")


# ---- roles ---------------------------------------------------------------------------


def _mission_ctx(spark, d):
    m = frame(spark, d, "fx_missions")
    reach = F.greatest("max_site_distance_km", "route_length_km", F.sqrt("aoi_area_km2"))
    return m.withColumn("reach_km", reach)


def roles(spark, d):
    return RD.assign_roles(frame(spark, d, "fx_arsenal"), _mission_ctx(spark, d))


_NODE_VALUES = ", ".join(
    f"({i}, '{n[0]}', '{n[1]}', '{n[2]}', {n[5]}e0, '{n[4][0]}', '{n[4][1]}', '{n[4][2] if len(n[4]) > 2 else '-'}')"
    for i, n in enumerate(RD.NODE_ROLES)
)
ROLES_SQL = f"""
nd AS (SELECT * FROM (VALUES {_NODE_VALUES}) AS t(node_no, node, node_label, supply, cap, p1, p2, p3)),
ctx AS (SELECT mission_id, urban_frac, ruggedness_m, greatest(max_site_distance_km, route_length_km, sqrt(aoi_area_km2)) AS reach FROM {{fx_missions}}),
sc AS (SELECT a.*, nd.*, urban_frac, reach, {_BAND} AS band, floor(
  CASE role WHEN p1 THEN 40 WHEN p2 THEN 26 WHEN p3 THEN 16 ELSE 4 END + CASE WHEN role IN ('hf', 'satcom') THEN -30 WHEN role = 'lora' THEN -18 ELSE 0 END
  + CASE WHEN power_w > cap * 1.5e0 THEN -14 ELSE 0 END + CASE WHEN supply = 'battery' THEN CASE WHEN power_w <= 8 THEN 6 WHEN power_w > 12 THEN -6 ELSE 0 END ELSE least(12e0, power_w / 5) END
  + CASE WHEN urban_frac >= 0.25e0 AND {_BAND} = 'UHF' THEN 6 ELSE 0 END + CASE WHEN reach > 30 AND {_BAND} = 'VHF' THEN 6 ELSE 0 END
  + CASE WHEN ruggedness_m >= 120 AND node IN ('rebro-static', 'hq') THEN 4 ELSE 0 END + 0.5e0) AS score
 FROM {{fx_arsenal}} a JOIN ctx USING (mission_id) CROSS JOIN nd),
rk AS (SELECT *, row_number() OVER (PARTITION BY mission_id, node_no ORDER BY score DESC, radio_id) AS k FROM sc),
asg AS (SELECT mission_id, node_no, any_value(node) AS node, any_value(node_label) AS node_label, any_value(supply) AS supply, max(CASE WHEN k = 1 THEN radio_id END) AS radio_id, max(CASE WHEN k = 1 THEN label END) AS radio_label, max(CASE WHEN k = 1 THEN score END) AS score,
 max(CASE WHEN k = 1 THEN label || ' — ' || band || ' ' || CASE WHEN role IN (p1, p2, p3) THEN role ELSE '(' || role || ')' END || '; ' || CAST(power_w AS BIGINT) || ' W'
  || CASE WHEN supply <> 'battery' AND power_w >= 25 THEN '; strong enough for a mast or a vehicle' WHEN supply = 'battery' AND power_w <= 8 THEN '; little current, as a carried set needs' ELSE '' END
  || CASE WHEN urban_frac >= 0.25e0 AND band = 'UHF' THEN '; UHF for the buildings here' ELSE '' END || CASE WHEN reach > 30 AND band = 'VHF' THEN '; VHF for the distance' ELSE '' END || '.' END) AS why,
 coalesce(concat_ws(', ', max(CASE WHEN k = 2 THEN label END), max(CASE WHEN k = 3 THEN label END)), '') AS alternatives
 FROM rk WHERE k <= 3 GROUP BY mission_id, node_no),
assigned AS (SELECT m.mission_id, nd.node_no, nd.node, nd.node_label, nd.supply AS node_supply, radio_id, radio_label, coalesce(score, 0e0) AS score, coalesce(why, '{RD.NO_RADIOS}') AS why, coalesce(alternatives, '') AS alternatives
 FROM {{fx_missions}} m CROSS JOIN nd LEFT JOIN asg ON asg.mission_id = m.mission_id AND asg.node_no = nd.node_no)"""


@query("assign_roles", f"WITH {ROLES_SQL} SELECT mission_id, node, radio_id, radio_label, score, why, alternatives FROM assigned")
def assign_roles(spark, d):
    return roles(spark, d).select("mission_id", "node", "radio_id", "radio_label", "score", "why", "alternatives")


MIX_SQL = """
mi AS (SELECT mission_id, max_site_distance_km AS site, ruggedness_m >= 120 AS rugged, urban_frac AS u, coverage_frac AS cov, point_count AS pts, greatest(max_site_distance_km, route_length_km, sqrt(aoi_area_km2)) AS reach FROM {fx_missions}),
cd AS (
 SELECT mission_id, 0 AS no, 'VHF' AS band, 60 - u * 30 AS score, 'VHF: reaches furthest across hills and woods, so it carries the ground net' || CASE WHEN rugged THEN '; steep ground here calls for high masts or relays' ELSE '' END || '.' AS why FROM mi
 UNION ALL SELECT mission_id, 1, 'UHF', 40 + u * 80 + CASE WHEN site > 0 AND site < 3 THEN 20 ELSE 0 END, CASE WHEN u >= 0.25e0 THEN 'UHF: ' || CAST(floor(u * 100 + 0.5e0) AS BIGINT) || '% of the demand lies among buildings, which UHF enters more easily.' ELSE 'UHF: the sites lie close together, where a shorter wave does well.' END FROM mi WHERE u >= 0.25e0 OR (site > 0 AND site < 3)
 UNION ALL SELECT mission_id, 2, 'HF NVIS', 70 + least(reach, 200e0) / 10 + CASE WHEN rugged THEN 8 ELSE 0 END, 'HF NVIS: the longest path needed is about ' || CASE WHEN reach >= 100 THEN printf('%.0f', reach) ELSE printf('%.1f', reach) END || ' km, more than VHF or UHF can see; the sky wave closes the gap' || CASE WHEN rugged THEN ' behind the ridges' ELSE '' END || '. It is planned apart from coverage.' FROM mi WHERE reach > 50
 UNION ALL SELECT mission_id, 3, 'LoRa', 45e0, 'LoRa: ' || pts || ' fixed points can report position and status at a low rate beside the voice net.' FROM mi WHERE pts >= 8
 UNION ALL SELECT mission_id, 4, 'Satcom', CASE WHEN cov > 0 AND cov < 0.5e0 THEN 66e0 ELSE 30e0 END, CASE WHEN cov > 0 AND cov < 0.5e0 THEN 'Satcom: no more than ' || CAST(floor(cov * 100 + 0.5e0) AS BIGINT) || '% of the demand is covered from the ground; satellite links serve emergencies and blocked places.' ELSE 'Satcom: the link for emergencies, and for places that no ground station covers.' END FROM mi),
rkd AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(CASE WHEN band IN ('Satcom', 'HF NVIS') THEN 0 ELSE 1 END) OVER (PARTITION BY mission_id ORDER BY score DESC, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cd WINDOW w AS (PARTITION BY mission_id ORDER BY score DESC, no)),
mix AS (SELECT mission_id, band, rank, CASE WHEN band = 'Satcom' THEN 'Emergency' WHEN band = 'HF NVIS' THEN 'Contingency' WHEN before = 0 THEN 'Primary' WHEN before = 1 THEN 'Alternate' ELSE 'Contingency' END AS pace, why FROM rkd)"""


@query("recommend_mix", f"WITH {MIX_SQL} SELECT mission_id, band, rank, pace, why FROM mix")
def recommend_mix(spark, d):
    out = RD.recommend_mix(frame(spark, d, "fx_missions"))
    return out.select("mission_id", "band", big("rank"), "pace", "why")


_STRUCT = """
SELECT s_suppkey AS mission_id, s_suppkey % 3 AS pair_no, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name, CASE s_suppkey % 4 WHEN 0 THEN 7e0 WHEN 1 THEN 60e0 WHEN 2 THEN 450e0 ELSE 1800e0 END AS freq_lo, 'set ' || s_suppkey AS label FROM {supplier}"""


def _g(tier: str) -> str:
    return PA.GAP_TEXT[tier].replace("'", "''")


_AIR_AT = "CASE WHEN drone_alt_m IS NOT NULL THEN ' @ ' || CAST(floor(drone_alt_m + 0.5e0) AS BIGINT) || ' m' ELSE '' END"
PACE_SQL = f"""
{MIX_SQL.strip()}, st AS ({_STRUCT.strip()}),
sb AS (SELECT mission_id, CASE WHEN freq_lo < 30 THEN 'HF NVIS' WHEN freq_lo < 88 THEN 'VHF' ELSE 'UHF' END AS band, 10 + pair_no AS rank, CASE WHEN name = '' THEN 'Structure ' || (pair_no + 1) ELSE name END || ' — ' || label AS why FROM st WHERE freq_lo < 1000),
bd AS (SELECT mission_id, band, rank, why FROM mix UNION ALL SELECT * FROM sb WHERE NOT EXISTS (SELECT 1 FROM mix WHERE mix.mission_id = sb.mission_id AND mix.band = sb.band)),
tr AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY rank) AS k FROM bd WHERE band IN ('VHF', 'UHF')),
pm AS (SELECT m.*, fixed_sites + recommended_sites AS total, t1.band AS b1, t1.why AS w1, t2.band AS b2, t2.why AS w2, h.why AS hf, s.why AS sat, l.why AS lora FROM {{fx_missions}} m
 LEFT JOIN tr t1 ON t1.mission_id = m.mission_id AND t1.k = 1 LEFT JOIN tr t2 ON t2.mission_id = m.mission_id AND t2.k = 2
 LEFT JOIN bd h ON h.mission_id = m.mission_id AND h.band = 'HF NVIS' LEFT JOIN bd s ON s.mission_id = m.mission_id AND s.band = 'Satcom' LEFT JOIN bd l ON l.mission_id = m.mission_id AND l.band = 'LoRa'),
lg AS (SELECT *, CASE WHEN b1 IS NULL THEN 'gap' ELSE 'ok' END AS s1, CASE WHEN b2 IS NOT NULL THEN 'ok' WHEN drone_relay THEN 'asset' ELSE 'gap' END AS s2,
  CASE WHEN hf IS NOT NULL THEN 'separate' WHEN drone_relay AND b2 IS NOT NULL THEN 'asset' ELSE 'gap' END AS s3, CASE WHEN sat IS NULL THEN 'gap' ELSE 'asset' END AS s4 FROM pm),
cl AS (SELECT *, cell_for_pace = 'alternate' AND s2 = 'gap' AS c2, cell_for_pace = 'contingency' AND s3 = 'gap' AS c3,
  CASE WHEN ew_threat = 'high' THEN 'Cellular (private LTE)' ELSE 'Cellular (LTE/4G)' END AS cb FROM lg),
nm AS (SELECT *, CASE WHEN s1 = 'gap' THEN '—' ELSE b1 END AS n1, CASE WHEN c2 THEN cb WHEN s2 = 'ok' THEN b2 WHEN s2 = 'asset' THEN 'UAS relay' ELSE '—' END AS n2,
  CASE WHEN c3 THEN cb WHEN s3 = 'separate' THEN 'HF NVIS' WHEN s3 = 'asset' THEN 'UAS relay' ELSE '—' END AS n3, CASE WHEN s4 = 'gap' THEN '—' ELSE 'Satcom' END AS n4,
  concat_ws(', ', CASE WHEN cell_for_pace <> 'none' AND NOT c2 AND NOT c3 THEN cb END, CASE WHEN ew_threat = 'high' AND cell_for_pace = 'none' THEN '{PA.CELL_RISK[0]}' END, CASE WHEN lora IS NOT NULL THEN 'LoRa' END) AS ov,
  concat_ws(', ', CASE WHEN s1 = 'gap' THEN 'Primary' END, CASE WHEN s2 = 'gap' AND NOT c2 THEN 'Alternate' END, CASE WHEN s3 = 'gap' AND NOT c3 THEN 'Contingency' END, CASE WHEN s4 = 'gap' THEN 'Emergency' END) AS gp,
  CASE WHEN total <= 0 THEN 'standalone' WHEN total = 1 THEN 'single-hub' ELSE 'relay-network' END AS topology FROM cl)"""


@query("pace_plan", f"""
WITH {PACE_SQL}
SELECT mission_id, topology, ov AS overlays, gp AS gaps,
 CASE WHEN total <= 0 THEN 'No mast is placed or recommended, so sets speak directly, modelled at 1.5 m above ground.'
  ELSE CASE WHEN total = 1 THEN 'One site' ELSE total || ' relay sites' END || CASE WHEN fixed_sites > 0 THEN ' · ' || fixed_sites || ' fixed' ELSE '' END || CASE WHEN recommended_sites > 0 THEN ' · ' || recommended_sites || ' recommended' ELSE '' END || '; the path from a handheld up to the mast decides, modelled at 1.5 m.' END AS note,
 concat_ws(' ', 'Primary ' || n1 || CASE WHEN total > 0 THEN ' over a ' || topology ELSE '' END || ', Alternate ' || n2 || ', Contingency ' || n3 || ', Emergency ' || n4 || '.',
  'The latest coverage run serves ' || CAST(floor(coverage_frac * 100 + 0.5e0) AS BIGINT) || '% of demand' || CASE WHEN terrain THEN ' (with terrain).' ELSE ' (without terrain).' END,
  CASE WHEN ov <> '' THEN 'Besides: ' || ov || '.' END, CASE WHEN gp <> '' THEN 'Open: ' || gp || '.' END, 'For planning only.') AS summary
FROM nm""")
def pace_plan(spark, d):
    m = frame(spark, d, "fx_missions")
    out = PA.pace_plan(RD.recommend_mix(m), m, sql(spark, d, _STRUCT))
    return out.select(
        "mission_id", "topology", F.array_join(F.transform("overlays", lambda o: o["band"]), ", ").alias("overlays"),
        F.array_join("gaps", ", ").alias("gaps"), "note", "summary",
    )


@query("plan_tables", f"""
WITH {PACE_SQL},
cw AS (SELECT *, CASE cell_for_pace WHEN 'alternate' THEN 'Alternate' ELSE 'Contingency' END AS ct, CASE ew_threat WHEN 'high' THEN '{PA.CELL_ROLE['high']}' WHEN 'medium' THEN '{PA.CELL_ROLE['medium']}' ELSE '{PA.CELL_ROLE['other']}' END AS cr FROM nm),
cx AS (SELECT *, CASE WHEN ew_threat = 'high' THEN 'Under a high EW threat public networks are out and private encrypted LTE remains, as the last choice for the ' || ct || ' path.' ELSE 'Cellular for the ' || lower(ct) || ' path: ' || cr || '. EW threat is ' || ew_threat || '.' END AS cy FROM cw)
SELECT mission_id, 'Primary' AS tier, b1 AS band, s1 AS status, coalesce(w1, '{_g('Primary')}') AS why FROM cx
UNION ALL SELECT mission_id, 'Alternate', CASE WHEN c2 THEN cb WHEN s2 = 'ok' THEN b2 WHEN s2 = 'asset' THEN 'UAS relay' END, CASE WHEN c2 THEN 'asset' ELSE s2 END,
 CASE WHEN c2 THEN cy WHEN s2 = 'ok' THEN w2 WHEN s2 = 'asset' THEN 'Drone relay' || {_AIR_AT} || ': carries the Alternate path over obstacles for as long as its battery lasts.' ELSE '{_g('Alternate')}' END FROM cx
UNION ALL SELECT mission_id, 'Contingency', CASE WHEN c3 THEN cb WHEN s3 = 'separate' THEN 'HF NVIS' WHEN s3 = 'asset' THEN 'UAS relay' END, CASE WHEN c3 THEN 'asset' ELSE s3 END,
 CASE WHEN c3 THEN cy WHEN s3 = 'separate' THEN hf WHEN s3 = 'asset' THEN 'Drone relay' || {_AIR_AT} || ': carries the Contingency path over obstacles for as long as its battery lasts.' ELSE '{_g('Contingency')}' END FROM cx
UNION ALL SELECT mission_id, 'Emergency', CASE WHEN sat IS NOT NULL THEN 'Satcom' END, s4, coalesce(sat, '{_g('Emergency')}') FROM cx""")
def plan_tables(spark, d):
    """The report's tier table."""
    m = frame(spark, d, "fx_missions")
    mix = RD.recommend_mix(m)
    sites = frame(spark, d, "fx_m_sites").select("mission_id", F.lit("Fixed").alias("kind"), F.lit(1).alias("ordinal"), "name", "lat", "lng", F.lit(None).cast("double").alias("elev_m"))
    tables = PA.plan_tables(PA.pace_plan(mix, m, sql(spark, d, _STRUCT)), mix, sites, m, mix)
    return tables["tiers"].select("mission_id", "tier", "band", "status", "why")


# ---- power ------------------------------------------------------------------------------

DUTY_SQL = """
dm AS (SELECT *, hours * 60e0 AS mm FROM {fx_missions}),
d1 AS (SELECT *, least(CASE WHEN tx_min > 0 THEN floor(mm / every_min) * tx_min ELSE 0e0 END, mm) AS tx_m FROM dm),
d2 AS (SELECT *, least(continuous_h * 60, mm - tx_m) AS rx_m FROM d1),
duty AS (SELECT *, tx_m / mm AS tx, rx_m / mm AS rx, greatest(0e0, mm - tx_m - rx_m) / mm AS standby FROM d2)"""


@query("duty_cycle", f"WITH {DUTY_SQL} SELECT mission_id, {R('tx', 6)} AS tx, {R('rx', 6)} AS rx, {R('standby', 6)} AS standby FROM duty")
def duty_cycle(spark, d):
    w = F.array(F.struct(F.col("every_min"), F.col("tx_min")))
    out = frame(spark, d, "fx_missions").select("mission_id", PW.duty_cycle("hours", w, "continuous_h").alias("d"))
    return out.select("mission_id", r("d.tx", 6, "tx"), r("d.rx", 6, "rx"), r("d.standby", 6, "standby"))


_PROFILE_SQL = ", ".join(
    f"('{k}', '{v[0]}', " + ", ".join("NULL" if x is None else f"{x}e0" for x in v[1:]) + ")" for k, v in PW.POWER_PROFILES.items()
)


@query("operator_endurance", f"""
WITH pf AS (SELECT * FROM (VALUES {_PROFILE_SQL}) AS t(role, supply, ta, ra, sa, ah, v)),
e AS (SELECT radio_id, 0.05e0 * coalesce(ta, 0) + 0.05e0 * coalesce(ra, 0) + 0.9e0 * coalesce(sa, 0) AS a, coalesce(CASE WHEN radio_id % 3 = 0 THEN (2000 + radio_id % 900) / 1000e0 END, ah, 0e0) AS cap FROM {{fx_radios}} JOIN pf USING (role)),
h AS (SELECT *, CASE WHEN a > 0 THEN cap / a END AS hrs FROM e)
SELECT radio_id, {R('a', 6)} AS current_a, {R('hrs')} AS hours, CAST(CASE WHEN hrs > 0 THEN greatest(1, ceil(72 / hrs)) ELSE 1 END AS BIGINT) AS batteries,
 CAST(CASE WHEN hrs > 0 THEN greatest(1, ceil(72 / hrs)) ELSE 1 END + 1 AS BIGINT) AS with_spare FROM h""")
def operator_endurance(spark, d):
    usual = F.struct(F.lit(0.05).alias("tx"), F.lit(0.05).alias("rx"), F.lit(0.9).alias("standby"))
    mah = F.when(F.col("radio_id") % 3 == 0, 2000 + F.col("radio_id") % 900)
    out = frame(spark, d, "fx_radios").select("radio_id", PW.operator_endurance(PW.profile_of("role"), F.lit(72.0), usual, mah).alias("e"))
    return out.select("radio_id", r("e.current_a", 6, "current_a"), r("e.hours", 4, "hours"), "e.batteries", "e.with_spare")


_PANEL = "CASE WHEN {0} > 0 THEN CASE WHEN {0} <= 20 THEN 20e0 WHEN {0} <= 50 THEN 50e0 WHEN {0} <= 100 THEN 100e0 WHEN {0} <= 200 THEN 200e0 WHEN {0} <= 400 THEN 400e0 ELSE ceil({0} / 100) * 100 END ELSE 0e0 END"


@query("site_energy", f"""
WITH s AS (SELECT site_id, tx_height_m * 2 AS w, lat - (site_id % 3) * 20 AS la FROM {{fx_sites}}), e AS (SELECT *, w * 72 * 0.3e0 AS wh, CASE WHEN abs(la) < 30 THEN 5.5e0 WHEN abs(la) <= 50 THEN 4e0 ELSE 3e0 END AS sun FROM s), p AS (SELECT *, wh / (sun * 0.85e0) AS pw FROM e)
SELECT site_id, {R('wh')} AS energy_wh, {R('wh / 12')} AS ah_12v, {R('wh / 24')} AS ah_24v, {R('pw')} AS panel_w, {_PANEL.format('pw')} AS panel_rounded_w, sun AS sun_hours FROM p""")
def site_energy(spark, d):
    s = frame(spark, d, "fx_sites").select("site_id", PW.site_energy(F.col("tx_height_m") * 2, F.lit(72.0)).alias("e"), (F.col("lat") - F.col("site_id") % 3 * 20).alias("la"))
    s = s.withColumn("p", PW.solar_panel("e.energy_wh", "la"))
    return s.select("site_id", *[r(f"e.{k}", 4, k) for k in ("energy_wh", "ah_12v", "ah_24v")], r("p.panel_w", 4, "panel_w"), "p.panel_rounded_w", "p.sun_hours")


@query("drone_endurance", """
WITH h AS (SELECT mission_id, (drone_wh + mission_id) * 0.8e0 / 150 AS hrs, hours FROM {fx_missions})
SELECT mission_id, CAST(floor(hrs * 60) AS BIGINT) AS minutes, CAST(ceil(hours / hrs) AS BIGINT) AS packs FROM h""")
def drone_endurance(spark, d):
    out = frame(spark, d, "fx_missions").select("mission_id", PW.drone_endurance(F.col("drone_wh") + F.col("mission_id"), mission_hours="hours").alias("e"))
    return out.select("mission_id", "e.minutes", "e.packs")


def _bank(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CASE WHEN {n} <= 5000 THEN 5000e0 WHEN {n} <= 10000 THEN 10000e0 WHEN {n} <= 20000 THEN 20000e0 ELSE 26800e0 END ELSE 0e0 END"


@query("powerbank_plan", f"""
WITH u AS (SELECT mission_id, eud_ma * hours AS used, eud_mah FROM {{fx_missions}}), n AS (SELECT *, ceil(greatest(0e0, used - eud_mah) / 0.65e0) AS need, ceil(used / 0.65e0) AS f FROM u)
SELECT mission_id, used AS consumed_mah, need AS rated_mah, {_bank('need')} AS size_mah, CAST(coalesce(ceil(need / nullif({_bank('need')}, 0)), 0) AS BIGINT) AS count, {_bank('f')} AS full_size_mah, CAST(ceil(f / {_bank('f')}) AS BIGINT) AS full_count FROM n""")
def powerbank_plan(spark, d):
    out = frame(spark, d, "fx_missions").select("mission_id", PW.powerbank_plan("eud_ma", "hours", "eud_mah").alias("p"))
    return out.select("mission_id", *[f"p.{k}" for k in ("consumed_mah", "rated_mah", "size_mah", "count", "full_size_mah", "full_count")])


_TEAMS = """
SELECT CAST(c_nationkey AS BIGINT) AS mission_id, c_custkey AS seq, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS name, CASE c_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '0.4' ELSE CAST(c_custkey % 300 AS VARCHAR(20)) END AS members,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'r' || c_custkey END AS radio_id, c_acctbal AS power_wh, c_custkey % 9 / 1e0 AS tx_w FROM {customer}"""


@query("normalize_teams", f"""
WITH t AS ({_TEAMS.strip()}), n AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY seq) AS k FROM t)
SELECT mission_id, seq, coalesce(nullif(trim(name), ''), 'Team ' || k) AS name, CAST(coalesce(CASE WHEN TRY_CAST(members AS DOUBLE) IS NOT NULL THEN least(200, greatest(1, floor(TRY_CAST(members AS DOUBLE)))) END, 4) AS BIGINT) AS members, coalesce(radio_id, '') AS radio_id, greatest(0e0, power_wh) AS power_wh FROM n""")
def normalize_teams(spark, d):
    return PW.normalize_teams(sql(spark, d, _TEAMS))


@query("team_endurance", f"""
WITH t AS ({_TEAMS.strip()}) SELECT seq, CASE WHEN power_wh > 0 AND tx_w > 0 THEN {R('power_wh / (tx_w * 0.1e0)')} END AS hours FROM t""")
def team_endurance(spark, d):
    return sql(spark, d, _TEAMS).select("seq", r(PW.team_endurance_h("power_wh", "tx_w"), 4, "hours"))


def plan_nodes(spark, d):
    # Roles and radios both read the arsenal, and a bill reads its nodes several times: each is made once.
    arsenal = cut_lineage(frame(spark, d, "fx_arsenal"))
    a = arsenal.select("mission_id", "radio_id", "role", "power_w", "battery_mah", "price")
    return cut_lineage(RD.assign_roles(arsenal, _mission_ctx(spark, d)).join(a, ["mission_id", "radio_id"], "left"))


def power(spark, d):
    return PW.power_plan(plan_nodes(spark, d), frame(spark, d, "fx_missions"))


POWER_SQL = f"""
{ROLES_SQL.strip()}, {DUTY_SQL.strip()}, pf AS (SELECT * FROM (VALUES {_PROFILE_SQL}) AS t(role, psupply, ta, ra, sa, ah, v)),
nx AS (SELECT g.*, x.role, x.power_w, x.battery_mah, x.price, duty.tx, duty.rx, duty.standby, duty.hours, duty.bank_v, duty.lat, duty.eud_ma, duty.eud_mah, duty.drone_wh, duty.drone_relay, pf.* EXCLUDE (role), coalesce(x.battery_mah / 1000, pf.ah, 0e0) AS cap,
  duty.tx * coalesce(ta, 0) + duty.rx * coalesce(ra, 0) + duty.standby * coalesce(sa, 0) AS cur, CASE WHEN radio_label IS NULL THEN 'none' ELSE node_supply END AS supply
 FROM assigned g LEFT JOIN {{fx_arsenal}} x ON x.mission_id = g.mission_id AND x.radio_id = g.radio_id JOIN duty ON duty.mission_id = g.mission_id LEFT JOIN pf ON pf.role = x.role),
ny AS (SELECT *, CASE WHEN cur > 0 THEN cap / cur END AS hrs, CASE WHEN abs(lat) < 30 THEN 5.5e0 WHEN abs(lat) <= 50 THEN 4e0 ELSE 3e0 END AS sun FROM nx),
pplan AS (SELECT *, CASE WHEN supply = 'battery' THEN CASE WHEN hrs > 0 THEN greatest(1, ceil(hours / hrs)) ELSE 1 END END AS bats, power_w * 24 * 0.3e0 / (sun * 0.85e0) AS day_panel, power_w * hours * 0.3e0 AS wh FROM ny)"""


@query("power_plan", f"""
WITH {POWER_SQL}
SELECT mission_id, node, supply, CASE WHEN supply = 'battery' THEN {R('hrs')} END AS endurance_h, CAST(bats AS BIGINT) AS batteries, CASE WHEN supply = 'mains' THEN {_PANEL.format('day_panel')} END AS solar_w,
 CASE WHEN supply = 'mains' THEN floor(power_w * 24 * 0.3e0 + 0.5e0) END AS energy_wh_day, CASE WHEN supply = 'mains' THEN {R('wh / CASE WHEN bank_v >= 24 THEN 24 ELSE 12 END')} END AS bank_ah FROM pplan""")
def power_plan(spark, d):
    return power(spark, d).select("mission_id", "node", "supply", r("endurance_h"), "batteries", "solar_w", "energy_wh_day", r("bank_ah"))


def bom_lines(spark, d, nodes=None):
    m = frame(spark, d, "fx_missions").withColumn("drone_wh", F.when(F.col("drone_relay"), F.col("drone_wh")))
    plan = power(spark, d) if nodes is None else PW.power_plan(nodes, frame(spark, d, "fx_missions"))
    return PW.network_bom(cut_lineage(plan), m)


LINES_SQL = f"""
{POWER_SQL.strip()},
lines AS (
 SELECT mission_id, '{PW.BILL_ITEMS['battery']}' AS item, CAST(sum(bats + 1) AS BIGINT) AS qty FROM pplan WHERE supply = 'battery' GROUP BY mission_id
 UNION ALL SELECT mission_id, '{PW.BILL_ITEMS['panel']}', count(*) FROM pplan WHERE supply = 'mains' GROUP BY mission_id
 UNION ALL SELECT mission_id, '{PW.BILL_ITEMS['drone']}', CAST(ceil(hours / (drone_wh * 0.8e0 / 150)) AS BIGINT) FROM {{fx_missions}} WHERE drone_relay
 UNION ALL SELECT mission_id, '{PW.BILL_ITEMS['bank']}', CAST(ceil(ceil(eud_ma * hours / 0.65e0) / {_bank('ceil(eud_ma * hours / 0.65e0)')}) AS BIGINT) FROM {{fx_missions}})"""


@query("network_bom", f"WITH {LINES_SQL} SELECT * FROM lines")
def network_bom(spark, d):
    return bom_lines(spark, d).select("mission_id", "item", "qty")


_PRICES = f"SELECT '{PW.BILL_ITEMS['battery']}' AS item, min(p_retailprice) AS price FROM {{part}} UNION ALL SELECT '{PW.BILL_ITEMS['panel']}', max(p_retailprice) FROM {{part}}"


def bom(spark, d):
    nodes = plan_nodes(spark, d)
    return PW.costed_bom(nodes, bom_lines(spark, d, nodes), sql(spark, d, _PRICES))


BOM_SQL = f"""
{LINES_SQL.strip()}, prices AS ({_PRICES}),
bom AS (SELECT mission_id, 'radio' AS kind, max(radio_label) AS item, count(*) AS qty, string_agg(node_label, ' · ' ORDER BY node_no) AS unit_spec, max(price) AS unit_price FROM pplan WHERE radio_label IS NOT NULL GROUP BY mission_id, radio_id
 UNION ALL SELECT mission_id, 'power', item, qty, NULL, price FROM lines LEFT JOIN prices USING (item))"""


@query("costed_bom", f"""
WITH {BOM_SQL} SELECT mission_id, kind, item, qty, CASE WHEN kind = 'radio' THEN unit_spec END AS unit_spec, {R('unit_price', 2)} AS unit_price, {R('unit_price * qty', 2)} AS total FROM bom""")
def costed_bom(spark, d):
    out = bom(spark, d)
    return out.select("mission_id", "kind", "item", "qty", F.when(F.col("kind") == "radio", F.col("unit_spec")).alias("unit_spec"), r("unit_price", 2), "total")


@query("bom_totals", f"""
WITH {BOM_SQL} SELECT mission_id, {R('coalesce(sum(' + R('unit_price * qty', 2) + '), 0)', 2)} AS total_known, count(*) FILTER (unit_price IS NULL) AS unpriced, count(unit_price) AS priced FROM bom GROUP BY mission_id""")
def bom_totals(spark, d):
    return PW.bom_totals(bom(spark, d))


@query("write_bom_csv")
def write_bom_csv(spark, d):
    return PW.bom_rows(bom(spark, d))


_ERL = """
er AS (SELECT id, a, 0 AS k, 1e0 AS b FROM src UNION ALL SELECT id, a, k + 1, a * b / (k + 1 + a * b) FROM er WHERE k < 64)"""


@query("erlang_b", f"""
WITH src AS (SELECT meas_id AS id, (-40e0 - dbm) / 40 AS a FROM {{fx_measurements}}), {_ERL}
SELECT id AS meas_id, {R('b', 6)} AS blocking FROM er WHERE k = 1 + id % 12""", recursive=True)
def erlang_b(spark, d):
    m = frame(spark, d, "fx_measurements")
    return m.select("meas_id", r(PW.erlang_b(1 + F.col("meas_id") % 12, (-40.0 - F.col("dbm")) / 40), 6, "blocking"))


@query("capacity_plan", f"""
WITH src AS (SELECT team AS id, users * calls_per_user_hour * avg_call_sec / 3600 AS a FROM {{fx_traffic}}), {_ERL},
q AS (SELECT id, max(a) AS load, max(CASE WHEN k = 2 THEN b END) AS blocking, coalesce(min(CASE WHEN k >= 1 AND b <= 0.02e0 THEN k END), 64) AS need FROM er GROUP BY id)
SELECT id AS team, {R('load', 6)} AS load, {R('blocking', 6)} AS blocking, CAST(need AS BIGINT) AS needed_slots, CAST(ceil(need / 2e0) AS BIGINT) AS needed_carriers, CAST(blocking <= 0.02e0 AS BIGINT) AS meets_target FROM q""", recursive=True)
def capacity_plan(spark, d):
    t = frame(spark, d, "fx_traffic").withColumn("timeslots", F.lit(2))
    out = PW.capacity_plan(t)
    return out.select("team", r("load", 6), r("blocking", 6), big("needed_slots"), big("needed_carriers"), big("meets_target"))


# ---- HF ------------------------------------------------------------------------------------

SUN_SQL = """
s0 AS (SELECT meas_id, ts, lat, lon, epoch_ms(ts) / 86400000e0 + 2440587.5e0 - 2451545e0 AS n, hour(ts) + minute(ts) / 60e0 + floor(second(ts)) / 3600e0 AS hh FROM {fx_measurements}),
s1 AS (SELECT *, radians((((280.46e0 + 0.9856474e0 * n) % 360) + 360) % 360) AS l, radians((((357.528e0 + 0.9856003e0 * n) % 360) + 360) % 360) AS g, radians(23.439e0 - 4e-7 * n) AS eps FROM s0),
s2 AS (SELECT *, l + radians(1.915e0 * sin(g) + 0.02e0 * sin(2 * g)) AS lam FROM s1),
s3 AS (SELECT *, asin(sin(eps) * sin(lam)) AS dec, degrees(atan2(cos(eps) * sin(lam), cos(lam))) AS ra0, ((6.697375e0 + 0.0657098242e0 * n + hh) % 24 + 24) % 24 AS gmst FROM s2),
s4 AS (SELECT *, radians(((gmst + lon / 15 - CASE WHEN ra0 < 0 THEN ra0 + 360 ELSE ra0 END / 15 + 24) % 24) * 15) AS ha FROM s3),
s5 AS (SELECT *, sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(ha) AS sa FROM s4),
sun AS (SELECT *, degrees(asin(sa)) AS altitude, degrees(acos(greatest(-1e0, least(1e0, (sin(dec) - sin(radians(lat)) * sa) / (cos(radians(lat)) * cos(asin(sa))))))) AS az FROM s5)"""


@query("solar_position", f"""
WITH {SUN_SQL} SELECT meas_id, {R('90 - altitude')} AS zenith, {R('altitude')} AS altitude, {R('CASE WHEN sin(ha) > 0 THEN 360 - az ELSE az END', 3)} AS azimuth FROM sun""")
def solar_position(spark, d):
    m = frame(spark, d, "fx_measurements").withColumn("ts", F.col("ts").cast("timestamp"))
    out = H.with_solar_position(m, "ts", "lat", "lon")
    return out.select("meas_id", r("zenith"), r("altitude"), r("azimuth", 3))


HF_SQL = f"""
{SUN_SQL.strip()},
h0 AS (SELECT meas_id, lat, month(ts) AS mo, 90 - altitude AS z, meas_id * 13 % 3000 AS p, 63 + 0.728e0 * CASE meas_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 100 ELSE 180 END AS fx FROM sun),
h1 AS (SELECT *, greatest(0e0, cos(radians(z))) AS dy, CASE WHEN mo BETWEEN 5 AND 9 THEN 'summer' ELSE 'winter' END AS season FROM h0),
h2 AS (SELECT *, ((4.5e0 + 0.02e0 * fx) * dy + (2.5e0 + 0.008e0 * fx) * (1 - dy)) * (1 - 0.004e0 * abs(lat)) * CASE season WHEN 'summer' THEN 1.1e0 ELSE 0.88e0 END AS f2 FROM h1),
h3 AS (SELECT *, least(30e0, f2 * CASE WHEN p <= 300 THEN 1.1e0 WHEN p <= 1500 THEN 1.1e0 + (p - 300) / 1200e0 * 1.9e0 ELSE 3 + p / 5000e0 END) AS muf, CASE WHEN z < 90 THEN 1.5e0 + 0.5e0 * dy * (fx / 80) + p / 2000e0 ELSE 1e0 END AS luf FROM h2),
bands AS (SELECT * FROM (VALUES {", ".join(f"('{b}', {lo}e0, {hi}e0)" for b, lo, hi in H.HF_BANDS)}) AS t(band, lo, hi)),
op AS (SELECT meas_id, bool_or(NOT (hi < luf OR lo >= muf)) AS any_open FROM h3 CROSS JOIN bands GROUP BY meas_id),
hf AS (SELECT h3.*, any_open, f2 > luf AND p <= 500 AS nvis, any_open AND p > 300 AND muf > luf AS sky FROM h3 JOIN op USING (meas_id))"""


def _conditions(spark, d):
    k = F.col("meas_id")
    m = frame(spark, d, "fx_measurements").select(
        "meas_id", F.col("ts").cast("timestamp").alias("ts"), "lat", F.col("lon").alias("lng"), (k * 13 % 3000).alias("path_km"),
        F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high").alias("solar_cycle"),
    )
    return H.hf_conditions(m)


@query("hf_conditions", f"""
WITH {HF_SQL} SELECT meas_id, {R('f2')} AS fo_f2, {R('muf')} AS muf, {R('luf')} AS luf, {R('0.85e0 * muf')} AS ouf, season, CASE WHEN nvis AND sky THEN 'both' WHEN nvis THEN 'nvis' WHEN sky THEN 'skywave' ELSE 'none' END AS mode FROM hf""")
def hf_conditions(spark, d):
    return _conditions(spark, d).select("meas_id", r("fo_f2"), r("muf"), r("luf"), r("ouf"), "season", "mode")


@query("hf_bands", f"""
WITH {HF_SQL}
SELECT meas_id, band, CASE WHEN hi < luf OR lo >= muf THEN 'no' WHEN lo > luf AND hi <= muf THEN 'viable' ELSE 'marginal' END AS status FROM hf CROSS JOIN bands""")
def hf_bands(spark, d):
    return H.hf_bands(_conditions(spark, d), keep=["meas_id"]).select("meas_id", "band", "status")


# ---- search -----------------------------------------------------------------------------------

_ITEMS = "SELECT p_brand AS section, p_partkey AS ordinal, p_name AS label, p_type AS keywords FROM {part}"
_QUERIES = """
SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN substr(n_name, 1, 2) WHEN 2 THEN ' P' WHEN 3 THEN 'st' ELSE '52.5, 4.9' END AS query FROM {nation}"""


def _tier_sql(t: str) -> str:
    return (
        f"CASE WHEN starts_with(lower({t}), q) THEN 100e0 WHEN len(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: starts_with(w, q))) > 0 THEN 80e0 "
        f"WHEN lower({t}) LIKE '%' || array_to_string(string_split(q, ''), '%') || '%' THEN 40e0 ELSE 0e0 END"
    )


@query("search_labels", f"""
WITH it AS ({_ITEMS}), qs AS ({_QUERIES.strip()}), qq AS (SELECT query_id, lower(trim(query)) AS q FROM qs WHERE query <> '52.5, 4.9'),
sc AS (SELECT query_id, section, ordinal, label, q, CASE WHEN q = '' THEN 0e0 ELSE greatest({_tier_sql('label')}, 0.5e0 * {_tier_sql('keywords')}) END AS score FROM it CROSS JOIN qq),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, ordinal) AS rank FROM sc WHERE score > 0 OR q = '')
SELECT query_id, section, rank, label, score FROM rk WHERE rank <= 6 UNION ALL SELECT query_id, 'Go to', 1, query, 0e0 FROM qs WHERE query = '52.5, 4.9'""")
def search_labels(spark, d):
    out = S.search_labels(sql(spark, d, _ITEMS), sql(spark, d, _QUERIES), top=6)
    return out.select("query_id", "section", big("rank"), "label", "score")


@query("sort_table", "SELECT radio_id, label, price FROM {fx_radios}")
def sort_table(spark, d):
    """Radios in falling price order, missing prices last."""
    return S.sort_table(frame(spark, d, "fx_radios").select("radio_id", "label", "price"), "price", ascending=False)
