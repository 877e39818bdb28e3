"""Queries on all classes of variable stars and on what their tables lack, with the SQL they are compared with."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..fixtures import VIEWS, ctes, view
from ..functions import coords, photometry
from ..operators import behaviour, catalogue, grid, sampling, series
from ..operators.ordering import with_row_number
from ..workspace import dealt, written
from . import catalogues as base
from .catalogues import _tidy

#: Every class of the behaviour table, the labels that stand for another name, and one that is in no table.
CLASSES = (*(r[0] for r in behaviour.BEHAVIOUR), *behaviour.ALIASES, "unheard of")


def _all_classes(spark, sf_dir):
    """Every source, the classes dealt by its id; periods and amplitudes are partly missing."""
    rows = view(spark, sf_dir, "sources")
    name = F.element_at(F.array(*map(F.lit, CLASSES)), (F.pmod("source_id", F.lit(len(CLASSES))) + 1).cast("int"))
    rows = rows.select("source_id", "l", "b", "parallax", "teff_gspphot", "bp_rp", "phot_g_mean_mag", name.alias("cls"))
    rows = rows.join(view(spark, sf_dir, "vari_summary"), "source_id", "left")
    return rows.withColumns({"period": F.lit(None).cast("double"), "amplitude": F.col("trimmed_range_mag_g_fov"), "phase": catalogue.phase_of_id(F.col("source_id"))})


def _epochs(spark):
    return spark.range(8).select(F.col("id").cast("int").alias("frame"), (F.col("id") * 17.25).alias("elapsed"), (F.col("id") / 7.0).alias("progress"), F.lit(1.0).alias("opacity"))


def light_curve_models(spark, sf_dir):
    """Every class, and so every model and flux mode, at eight epochs, summed up by class and frame."""
    stars = behaviour.with_parameters(behaviour.with_behaviour(_all_classes(spark, sf_dir)))
    stars = stars.withColumn("temperature", photometry.temperature(F.col("teff_gspphot"), F.col("bp_rp"), photometry.VARIABLE_FALLBACK_K))
    rows = behaviour.frames(stars, _epochs(spark))
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return rows.groupBy("behaviour_class", "model", "frame").agg(F.count("*").alias("n"), mean("signal"), mean("relative_flux"), mean("sigma"), mean("alpha"), mean("green"))


def star_ramps(spark, sf_dir):
    """How many stars are visible, and how far, at eight times of a video that fades out."""
    stars = behaviour.with_delays(view(spark, sf_dir, "sources").select("source_id"))
    both = stars.crossJoin(F.broadcast(_epochs(spark).select("frame", "progress")))
    shown = both.withColumn("a", behaviour.ramps(F.col("progress"), F.col("appears"), F.col("fades"), outro=0.2))
    return shown.groupBy("frame").agg(F.count_if(F.col("a") > 0).alias("visible"), F.round(F.avg("a"), 8).alias("mean_alpha"))


def _hot(spark, sf_dir):
    """Hot stars whose period or amplitude may be unusable; alternate periods are those of a pulsation study."""
    rows = _all_classes(spark, sf_dir).filter(F.col("cls").isin("BE", "WR", "RR_LYRAE"))
    study = view(spark, sf_dir, "vari_rrlyrae").select("source_id", "pf", "p1_o")
    rows = rows.drop("period", "amplitude").join(study, "source_id", "left")
    return rows.withColumns({"period": F.when(F.pmod("source_id", F.lit(2)) == 0, -1.0).otherwise(F.col("pf")), "alternate_period": F.col("p1_o"), "amplitude": F.when(F.pmod("source_id", F.lit(3)) == 0, F.col("std_dev_mag_g_fov")).when(F.pmod("source_id", F.lit(3)) == 1, -0.5), "trimmed_range_mag_g_fov": F.when(F.pmod("source_id", F.lit(5)) != 0, F.col("trimmed_range_mag_g_fov"))})


def period_fallback(spark, sf_dir):
    return _tidy(behaviour.with_fallbacks(_hot(spark, sf_dir)).select("source_id", "cls", "period", "amplitude"), 9)


def missing_defaults(spark, sf_dir):
    rows = _hot(spark, sf_dir).join(view(spark, sf_dir, "sources").select("source_id", "lum_flame", "radius_gspphot", "mass_flame"), "source_id")
    scores = view(spark, sf_dir, "vari_classifier_result").select("source_id", F.col("best_class_score").alias("classification_score"))
    return behaviour.default_counts(rows.join(scores, "source_id", "left"))


def surrogate_ids(spark, sf_dir):
    """Ids for the rows of the third catalogue (number 2) that have none."""
    rows = view(spark, sf_dir, "sources").select(F.when(F.col("source_id") % 4 == 0, None).when(F.col("source_id") % 7 == 0, -1).otherwise(F.col("source_id")).alias("source_id"), F.col("source_id").alias("input_seq"))
    return behaviour.with_surrogate_ids(rows, 2)


def map_sizes(spark, sf_dir):
    stars = behaviour.with_behaviour(_all_classes(spark, sf_dir))
    one, many = (behaviour.with_map_size(stars, x).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.sum("size_scale"), 6).alias("sum_size")) for x in (False, True))
    return one.join(many.select("cls", F.col("sum_size").alias("sum_size_all")), "cls")


def hot_sets(spark, sf_dir):
    """Rows of the split catalogues of hot stars if all of them have rows, else of their parent."""
    rows = _all_classes(spark, sf_dir).withColumn("cls", F.when(F.col("cls") == "UNKNOWN_HOT", "UNKNOWN").otherwise(F.col("cls")))
    # at most one row for each of a few dozen classes
    present = {r.cls for r in rows.select("cls").distinct().collect()}
    return rows.filter(F.col("cls").isin(*behaviour.subtype_set(present))).groupBy("cls").agg(F.count("*").alias("n"))


def window_sample(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").select("teff_gspphot", F.col("source_id").alias("id"))
    return _tidy(sampling.window_sample(with_row_number(rows, "input_seq", ["id"], 0), "teff_gspphot", 640), 7)


def stride_sample(spark, sf_dir):
    cells = grid.sky_histogram(view(spark, sf_dir, "sources"), 128, 64).select((F.col("y") * 128 + F.col("x")).alias("cell"), "flux")
    return _tidy(sampling.stride_sample(cells, "flux", 2000, 128 * 64), 12)


def class_sample(spark, sf_dir):
    """Samples of every class, in both buckets, with more rows wanted than one zone has."""
    rows = _all_classes(spark, sf_dir)
    return sampling.class_sample(rows, 1500).select("source_id", "cls", "bucket", "zone")


def frame_ecliptic(spark, sf_dir):
    rows = view(spark, sf_dir, "sources")
    lon, lat = coords.icrs_to_ecliptic(F.col("ra"), F.col("dec"))
    l, b = coords.to_galactic(lon, lat, "E")
    return rows.select("source_id", F.round(lat, 6).alias("ecl_lat"), (F.round(F.cos(F.radians(lon)), 7) + 0.0).alias("ecl_cos"), (F.round(F.cos(F.radians(l)), 7) + 0.0).alias("gal_cos"), F.round(b, 6).alias("gal_b"))


def sexagesimal(spark, sf_dir):
    """Declinations as texts of degrees, minutes and seconds, read back."""
    rows = view(spark, sf_dir, "sources").select("source_id", F.round(F.abs("dec") * 3600.0, 0).cast("long").alias("s"), F.when(F.col("dec") < 0, "-").otherwise("+").alias("sign"))
    text = F.concat("sign", F.floor(F.col("s") / 3600).cast("string"), F.lit(":"), F.floor(F.col("s") % 3600 / 60).cast("string"), F.lit(" "), (F.col("s") % 60).cast("string"))
    return rows.select("source_id", F.round(coords.sexagesimal(text), 9).alias("degrees"))


def colour_texts(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").withColumn("t", photometry.temperature(F.col("teff_gspphot"), F.col("bp_rp")))
    r, g, b = photometry.vivid_rgb(F.col("t"))
    return rows.select("source_id", photometry.hex_colour(r, g, b).alias("hex"), photometry.css_colour(r, g, b).alias("css"))


def unit_conversions(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").filter("parallax > 0").select("source_id", (F.lit(1.0) / F.col("parallax")).alias("kpc"), "phot_g_mean_mag", F.element_at(F.array(*map(F.lit, ("pc", "kpc", "Mpc", "ly", "au", "furlong"))), (F.pmod("source_id", F.lit(6)) + 1).cast("int")).alias("unit"))
    pc = photometry.to_parsecs(F.col("kpc"), F.col("unit"))
    return rows.select("source_id", F.round(F.log10(pc), 9).alias("log_pc"), F.round(photometry.magnitude(photometry.flux(F.col("phot_g_mean_mag"))), 9).alias("mag"))


def selected_ids(spark, sf_dir):
    stars = view(spark, sf_dir, "sources").select("source_id", "phot_g_mean_mag")
    return _tidy(catalogue.select_ids(stars, view(spark, sf_dir, "vari_microlensing").select("source_id"))[0], 9)


def line_vertices(spark, sf_dir):
    """Lines through the stars of 64 neighbouring ids, their positions found by id."""
    stars = written(view(spark, sf_dir, "sources", bounded=True).select(F.col("source_id").alias("hip"), "ra", "dec"), "stars")
    members = dealt(stars.select(F.floor(F.col("hip") / 64).alias("line_id"), "hip"), stars.count(), "line_id")
    lines = members.groupBy("line_id").agg(F.sort_array(F.collect_list("hip")).alias("hips"))
    return _tidy(series.line_vertices(lines, stars), 9)


def visible_runs(spark, sf_dir):
    """The runs of such lines that lie within 40 degrees of the plane."""
    points = view(spark, sf_dir, "sources").select(F.floor(F.col("source_id") / 64).alias("line_id"), F.col("source_id").alias("seq"), (F.abs("b") <= 40).alias("inside"))
    return series.visible_runs(points, "inside").select("line_id", "seq", F.col("piece").cast("long").alias("piece"))


QUERIES = {f.__name__: f for f in (light_curve_models, star_ramps, period_fallback, missing_defaults, surrogate_ids, map_sizes, hot_sets, window_sample, stride_sample, class_sample, frame_ecliptic, sexagesimal, colour_texts, unit_conversions, selected_ids, line_vertices, visible_runs)}

_S = ctes("sources")
_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
_K = f"k as (select source_id, l, b, parallax, teff_gspphot, bp_rp, phot_g_mean_mag, {_LIST}[(source_id % {len(CLASSES)} + 1)::int] as cls from sources)"
_P = ctes("sources", "vari_summary") + ", " + base._STAR.replace(base._CLASSES, _K)
_HOT = ctes("sources", "vari_summary", "vari_rrlyrae") + f""", {_K}, h as (select k.*, case when k.source_id % 2 = 0 then -1e0 else pf end as period, p1_o as alt,
 case when k.source_id % 3 = 0 then std_dev_mag_g_fov when k.source_id % 3 = 1 then -5e-1 end as amp, case when k.source_id % 5 <> 0 then trimmed_range_mag_g_fov end as tr, range_mag_g_fov as rg
 from k left join vari_summary using (source_id) left join vari_rrlyrae using (source_id) where cls in ('BE', 'WR', 'RR_LYRAE'))"""
_GREEN = base._GREEN
_CO, _SI = (f"{f(math.radians(coords.OBLIQUITY)):.16e}" for f in (math.cos, math.sin))
_VIVID = lambda i: "(case when t <= 2500 then " + f"{photometry.VIVID[0][i]:.17g}e0" + "".join(f" when t <= {b[0]} then {a[i]:.17g}e0 + (t - {a[0]}e0) * ({b[i] - a[i]:.17g}e0/{b[0] - a[0]}e0)" for a, b in zip(photometry.VIVID, photometry.VIVID[1:])) + " end)"
_BYTE = lambda i: f"round_even(least(greatest({_VIVID(i)}, 0e0), 1e0) * 255, 0)::int"
_WS = """, o as (select row_number() over (order by source_id) - 1 as input_seq, teff_gspphot, count(*) over () as n from sources),
w as (select distinct case when n <= 640 then 0 else ((n - 10) * i::double / 63)::double end as a, n from range(64) r(i), (select distinct n from o))"""
_BAL = base._BAL.replace("r <= 130", "r <= 650").replace("r1 <= 90", "r1 <= 450").replace("then 50 else 30", "then 250 else 150")
_CELLS = """, c as (select least(greatest(cast(floor((90 + b) * (64e0/180)) as bigint), 0), 63) * 128 + least(greatest(cast(floor((-(case when l > 180 then l - 360 else l end) + 180) * (128e0/360)) as bigint), 0), 127) as cell, sum(pow(1e1, -4e-1 * phot_g_mean_mag)) as flux from sources where l is not null and b between -90 and 90 and phot_g_mean_mag is not null group by 1)"""

ORACLE = {
    "light_curve_models": _P + f", {base._FR} select bc as behaviour_class, model, frame::int as frame, count(*) as n, round(avg(sg),6) as mean_signal, round(avg(rf),6) as mean_relative_flux, round(avg(sigma),6) as mean_sigma, round(avg(alpha),6) as mean_alpha, round(avg({_GREEN}),6) as mean_green from fin group by bc, model, frame",
    "star_ramps": _S + f""", a as (select i, least(greatest((i/7e0 - 2e-1*{base._uniform('source_id', 42)})/4e-2,0e0),1e0) * least(greatest((1-2e-1 + 1.6e-1*{base._uniform('source_id', 43)} - i/7e0)/4e-2,0e0),1e0) as a from sources, range(8) r(i))
select i::int as frame, count(*) filter (where a > 0) as visible, round(avg(a),8) as mean_alpha from a group by i""",
    "period_fallback": _HOT + """ select source_id, cls, round(coalesce(case when period > 0 then period end, case when alt > 0 then alt end, period),9) as period,
 round(case when cls in ('BE','WR') then coalesce(case when amp >= 0 then amp end, case when tr >= 0 then tr end, case when rg >= 0 then rg end, amp) else amp end,9) as amplitude from h""",
    "missing_defaults": _HOT + f""", c as ({VIEWS["vari_classifier_result"]})
select count(*) filter (where not coalesce(period > 0, false)) as missing_period, count(*) filter (where not coalesce(amp >= 0, false)) as missing_amplitude, count(*) filter (where lum_flame > 0) as luminosity,
 count(*) filter (where radius_gspphot > 0) as radius, count(*) filter (where mass_flame > 0) as mass, count(best_class_score) as classification_score
from h join (select source_id, lum_flame, radius_gspphot, mass_flame from sources) using (source_id) left join c using (source_id)""",
    "surrogate_ids": _S + """, r as (select source_id as input_seq, case when source_id % 4 = 0 then null when source_id % 7 = 0 then -1 else source_id end as source_id, row_number() over (order by source_id) - 1 as i from sources)
select case when coalesce(source_id < 0, true) then 3000000000000 + i else source_id end as source_id, input_seq from r""",
    "map_sizes": _S + f", {_K} select cls, count(*) as n, round(sum(2.2e0*1.65e0),6) as sum_size, round(sum(1e0),6) as sum_size_all from k group by cls",
    "hot_sets": _S + f", {_K}, u as (select case when cls = 'UNKNOWN_HOT' then 'UNKNOWN' else cls end as cls from k) select cls, count(*) as n from u where case when (select count(distinct cls) from u where cls in ('BE','GCAS','SDOR','WR','UNKNOWN')) = 5 then cls in ('BE','GCAS','SDOR','WR','UNKNOWN') else cls = 'LBV' end group by cls",
    "window_sample": _S + _WS + """ select input_seq, round(teff_gspphot,7) as teff_gspphot from o where teff_gspphot is not null and (n <= 640 or exists (select 1 from w where input_seq between trunc(a) and trunc(a) + 9)) order by input_seq limit 640""",
    "stride_sample": _S + _CELLS + " select cell, round(flux,12) as flux from c where flux <> 0 and (cell % 4 = 0 or (select count(*) from c where flux <> 0 and cell % 4 = 0) < 1000) order by cell limit 2000",
    "class_sample": _S + f""", {_K}, {_BAL}, mg as (select *, row_number() over (partition by cls order by hh, source_id) as r from kb where bucket = 'magellanic')
select source_id, cls, bucket, zone from mg where r <= 1500 union all select source_id, cls, bucket, zone from t6 where t5 or r3 <= 1500 - got""",
    "frame_ecliptic": _S + f""", v as (select source_id, l, b, ra, dec, cos(radians(dec))*cos(radians(ra)) as x, {_CO}*cos(radians(dec))*sin(radians(ra)) + {_SI}*sin(radians(dec)) as y, {_CO}*sin(radians(dec)) - {_SI}*cos(radians(dec))*sin(radians(ra)) as z from sources)
select source_id, round(degrees(asin(least(greatest(z,-1e0),1e0))),6) as ecl_lat, round(x/sqrt(x*x+y*y),7)+0e0 as ecl_cos, round({base._XYZ[0]}/sqrt(pow({base._XYZ[0]},2)+pow({base._XYZ[1]},2)),7)+0e0 as gal_cos, round(degrees(asin(least(greatest({base._XYZ[2]},-1e0),1e0))),6) as gal_b from v""",
    "sexagesimal": _S + "select source_id, round(case when dec < 0 then -1 else 1 end * round(abs(dec)*3600)/3600,9) as degrees from sources",
    "colour_texts": _S + f", k as (select source_id, least(greatest({base._TEMP('5.772e3')},2500e0),10000e0) as t from sources), c as (select source_id, {_BYTE(1)} as r, {_BYTE(2)} as g, {_BYTE(3)} as b from k) select source_id, printf('#%02x%02x%02x', r, g, b) as hex, printf('rgb(%d, %d, %d)', r, g, b) as css from c",
    "unit_conversions": _S + """, d as (select source_id, phot_g_mean_mag as g, 1/parallax as d, case source_id % 6 when 0 then 1e0 when 1 then 1e3 when 2 then 1e6 when 3 then 3.0660139378555057e-1 when 4 then pi()/648000 end as f from sources where parallax > 0)
select source_id, round(log10(d*f),9) as log_pc, round(-2.5e0*log10(pow(1e1,-4e-1*g)),9) as mag from d""",
    "selected_ids": ctes("sources", "vari_microlensing") + "select source_id, round(phot_g_mean_mag,9) as phot_g_mean_mag from sources where source_id in (select source_id from vari_microlensing)",
    "line_vertices": _S + "select source_id // 64 as line_id, (row_number() over (partition by source_id // 64 order by source_id) - 1)::int as seq, round(ra,9) as ra, round(dec,9) as dec from sources",
    "visible_runs": _S + """, p as (select source_id // 64 as line_id, source_id as seq, abs(b) <= 40 as i from sources), j as (select *, case when i <> lag(i) over (partition by line_id order by seq) then 1 else 0 end as c from p),
q as (select *, (sum(c) over (partition by line_id order by seq))::bigint as piece from j) select line_id, seq, piece from (select *, count(*) over (partition by line_id, piece) as n from q where i) where n >= 2""",
}
