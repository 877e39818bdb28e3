"""Queries on microlensing events and time series, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ctes, view
from ..functions import coords, lensing
from ..operators import behaviour, events, scenarios, series
from ..sources import sinks
from ..workspace import fresh_dir
from .catalogues import _tidy, _uniform


def _events(spark, sf_dir):
    """All fits with the sources they have; input_seq is the id's order."""
    fits, sources = view(spark, sf_dir, "vari_microlensing"), view(spark, sf_dir, "sources")
    stars = sources.select("source_id", "l", "b", "parallax", "parallax_error", "phot_g_mean_mag", "bp_rp", "teff_gspphot", "ebpminrp_gspphot")
    return fits.join(stars, "source_id", "left").withColumn("input_seq", F.col("source_id"))


def ml_rejects(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return events.reject_histogram(rows.unionByName(rows.filter("source_id % 5 = 0").withColumn("input_seq", F.col("input_seq") + 1)))


def ml_events(spark, sf_dir):
    rows = events.accepted(_events(spark, sf_dir))
    picked = rows.select("source_id", "te", "tmax", "u0", "x", "y", "a_max", "distance_pc", "distance_high_pc", "mass_status", "lens_category", "spectral", "peak_date")
    return _tidy(picked.withColumn("lens_mass", F.lit(None).cast("double")).drop("lens_mass"), 7)


def ml_index(spark, sf_dir):
    return events.with_index(events.accepted(_events(spark, sf_dir))).select("source_id", F.col("catalogue_index").cast("long").alias("catalogue_index"), "name")


def ml_meta(spark, sf_dir):
    return _tidy(events.summary(events.accepted(_events(spark, sf_dir))), 7)


def ml_set_summary(spark, sf_dir):
    """What is accepted and why the rest isn't; every fifth event comes twice, and some carry a catalogue mass."""
    rows = _events(spark, sf_dir).withColumn("lens_mass", F.when(F.col("source_id") % 3 == 0, F.col("paczynski1_bp0") - 16.0))
    rows = rows.unionByName(rows.filter("source_id % 5 = 0").withColumn("input_seq", F.col("input_seq") + 1))
    return _tidy(events.set_summary(rows).withColumn("reasons", F.to_json("reasons")), 7)


def ml_filters(spark, sf_dir):
    """Every quick filter, with and without a search text."""
    rows = _events(spark, sf_dir).withColumn("mass", F.when(F.col("source_id") % 3 == 0, F.col("paczynski1_bp0") - 16.0))
    rows = events.with_index(events.accepted(rows)).select("source_id", "name", "a_max", "te", "mass_status")
    found = None
    for kind in ("all", "strong", "short", "long", "catalogue_mass", "model_mass"):
        for text in ("", " 7 ", "ml–00"):
            one = events.quick_filter(rows, kind, text).agg(F.lit(kind).alias("kind"), F.lit(text.strip().lower().replace("–", "-")).alias("text"), F.count("*").alias("n"), F.sum("source_id").alias("ids"))
            found = one if found is None else found.unionByName(one)
    return found


def ml_masses(spark, sf_dir):
    """Catalogue and model masses, the status and the drawn mass."""
    rows = _events(spark, sf_dir).withColumn("paczynski_mass", F.when(F.col("source_id") % 3 == 0, F.col("paczynski1_bp0") - 16.0))
    kept = events.accepted(rows).withColumn("drawn", events.display_mass(rows))
    digits = lambda c: F.round(F.log10(c), 8)
    return kept.select("source_id", "mass_status", "mass_origin", "lens_category", digits("lens_mass").alias("mass"), F.round("drawn", 9).alias("drawn"), events.temperature_origin(F.col("teff_gspphot"), F.col("bp_rp")).alias("temperature_origin"))


def ml_export_csv(spark, sf_dir):
    """The CSV export, written and read again."""
    rows = events.export_rows(events.with_index(events.accepted(_events(spark, sf_dir))))
    sinks.save_csv(rows, path := fresh_dir(spark, "events-csv"), rows.columns)
    back = spark.read.option("header", True).schema("name string, sourceId long, l double, b double, tmax double, te double, u0 double, aMax double, parallax double, parallaxError double, distancePc double, lensMass double, massStatus string").csv(path)
    return _tidy(back.withColumn("lensMass", F.log10("lensMass")), 7)


def ml_export_json(spark, sf_dir):
    """The JSON payload of each event, read again."""
    rows = events.payload(events.accepted(_events(spark, sf_dir)))
    body = F.from_json("json", "source_id long, te double, date struct<date: string>, lens struct<mass_status: string>")
    return _tidy(rows.select(body.alias("x")).select("x.source_id", "x.te", F.col("x.date.date").alias("date"), F.col("x.lens.mass_status").alias("mass_status")), 9)


def comparison_csv(spark, sf_dir):
    """The long comparison table of light curves, written and read again."""
    rows = view(spark, sf_dir, "photometry_samples").withColumns({"temperature_k": 5000.0 + F.col("t_days"), "photospheric_radius_m": F.col("t_days") * 1e9})
    sinks.save_comparison(rows, path := fresh_dir(spark, "comparison"), "series", "t_days", "band", "mag", "flux", 100.0)
    back = spark.read.option("header", True).schema("scenario string, observer_time_days double, filter string, apparent_magnitude double, absolute_magnitude double, observed_flux_w_m2 double, temperature_k double, photospheric_radius_m double").csv(path)
    return back.groupBy("scenario", "filter", "observer_time_days").agg(F.count("*").alias("n"), F.round(F.avg("apparent_magnitude"), 7).alias("mag"), F.round(F.avg("absolute_magnitude"), 7).alias("abs_mag"), F.round(F.avg("observed_flux_w_m2"), 6).alias("flux"), F.round(F.max("temperature_k"), 6).alias("temperature_k"), F.round(F.max(F.col("photospheric_radius_m") / 1e9), 6).alias("radius_gm"))


def peak_percentiles(spark, sf_dir):
    rows = view(spark, sf_dir, "photometry_samples")
    return _tidy(series.peak_percentiles(rows, ["series", "band"], "sample", "t_days", "mag"), 7)


def scenario_draws(spark, sf_dir):
    """Parameters of each scenario's samples: drawn by hashes, limited, and put right where the final mass is too large."""
    rows = view(spark, sf_dir, "photometry_samples").select("series", "sample").distinct()
    base = rows.withColumns({"progenitor.initial_mass_solar": F.lit(18.0), "progenitor.final_mass_solar": F.lit(15.0), "model.energy_foe": F.lit(1.0)})
    key = F.substring("series", 4, 9).cast("long") * 100_000 + F.col("sample")
    drawn = scenarios.override(base, {"progenitor.initial_mass_solar": {"distribution": "uniform", "min": 10.0, "max": 20.0}, "progenitor.final_mass_solar": {"distribution": "uniform", "min": 9.0, "max": 18.0}, "model.energy_foe": {"distribution": "uniform", "min": 0.5, "max": 1.5}}, key)
    fixed = scenarios.repair(drawn)
    return fixed.select("series", "sample", *(F.round(F.col(f"`{c}`"), 9).alias(c.split(".")[1]) for c in fixed.columns if "." in c))


def ml_filter_strong(spark, sf_dir):
    rows = events.accepted(_events(spark, sf_dir)).withColumn("name", F.lit(""))
    return events.quick_filter(rows, "strong", "7").select("source_id")


def ml_mass_scenarios(spark, sf_dir):
    rows = events.accepted(_events(spark, sf_dir))
    scaled = lensing.rescale_mass(F.col("model_mass"), F.lit(150.0), F.lit(0.3))
    digits = lambda c: F.round(F.log10(c), 8)
    return rows.filter("model_mass is not null").select("source_id", digits(F.col("model_mass")).alias("mass"), digits(F.col("mass_low")).alias("low"), digits(F.col("mass_high")).alias("high"), digits(scaled).alias("scaled"))


def ml_level_choice(spark, sf_dir):
    return _tidy(events.choose_level(_events(spark, sf_dir)).select("source_id", "level", "tmax", "te", "u0", "share"), 9)


def ml_source_colour(spark, sf_dir):
    rows = _events(spark, sf_dir).join(view(spark, sf_dir, "astrophysical_parameters"), "source_id", "left")
    c = F.col
    valid = lensing.level_one_valid(c("paczynski1_tmax"), c("paczynski1_te"), c("paczynski1_u0"), c("paczynski1_fs_g"))
    kelvin, origin = lensing.source_temperature(c("teff_gspphot"), c("bp_rp"), c("ebpminrp_gspphot"), c("abp_gspphot"), c("arp_gspphot"), c("paczynski1_bp0"), c("paczynski1_rp0"), c("paczynski1_fs_bp"), c("paczynski1_fs_rp"), valid)
    return rows.select("source_id", F.round(kelvin, 6).alias("kelvin"), origin.alias("origin"))


def ml_activity_window(spark, sf_dir):
    return _tidy(events.activity_window(events.choose_level(_events(spark, sf_dir))), 6)


def ml_frames(spark, sf_dir):
    """Events at ten times of the activity window, summed up by frame."""
    rows = events.choose_level(_events(spark, sf_dir))
    axis = spark.range(10).select(F.col("id").cast("int").alias("frame"), (F.lit(1700.0) + F.col("id") * 100.0).alias("t"))
    both = rows.crossJoin(F.broadcast(axis))
    shown = lensing.display(F.col("t"), F.col("tmax"), F.col("te"), F.col("u0"), F.lit(1.0), F.col("share"), 8192.0)
    both = both.withColumns(shown)
    return both.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.avg("sigma"), 6).alias("mean_sigma"), F.round(F.avg("alpha"), 6).alias("mean_alpha"))


def ml_region_frames(spark, sf_dir):
    """Events inside the regional map at three times, drawn with their own lens mass where a catalogue gives one."""
    rows = _events(spark, sf_dir).withColumn("lens_mass", F.when(F.col("source_id") % 3 == 0, F.col("paczynski1_bp0") - 14.0))
    rows = events.choose_level(rows, coords.Region()).withColumn("drawn", events.display_mass(rows))
    both = rows.withColumn("t", F.explode(F.array(F.col("tmax") - F.col("te"), F.col("tmax"), F.lit(2200.0))))
    shown = lensing.display(F.col("t"), F.col("tmax"), F.col("te"), F.col("u0"), F.col("drawn"), F.col("share"), 4320.0)
    return _tidy(both.withColumns(shown).select("source_id", "t", "drawn", "strength", "sigma", "alpha"), 6)


def ml_images(spark, sf_dir):
    rows = events.choose_level(_events(spark, sf_dir)).filter("u0 > 0").withColumns(lensing.image_pair(F.col("u0")))
    return _tidy(rows.select("source_id", "theta_plus", "theta_minus", "mu_plus", "mu_minus", "mu_total"), 7)


def envelope(spark, sf_dir):
    rows = view(spark, sf_dir, "photometry_samples")
    return _tidy(series.envelope(rows, ["series", "band", "t_days"], "mag"), 7)


def peaks(spark, sf_dir):
    rows = view(spark, sf_dir, "photometry_samples")
    return _tidy(series.peaks(rows, ["series", "band", "sample"], "t_days", "mag"), 7)


def _means(spark, sf_dir):
    rows = view(spark, sf_dir, "photometry_samples")
    return rows.groupBy("series", "band", "t_days").agg(F.min("mag").alias("mag"))


def bright_phase(spark, sf_dir):
    return series.bright_phase(_means(spark, sf_dir), ["series", "band"], "t_days", "mag", 1.5)


def interp_at(spark, sf_dir):
    rows = _means(spark, sf_dir)
    wanted = rows.select("series", "band").distinct().crossJoin(F.broadcast(spark.range(-1, 12).select((F.col("id") * 47.3).alias("at"))))
    return _tidy(series.interpolate(rows, wanted, ["series", "band"], "t_days", "mag"), 6)


def polyline_seams(spark, sf_dir):
    """Lines through sources of neighbouring ids on a 3600-pixel map, cut where they jump."""
    rows = view(spark, sf_dir, "sources").select(F.floor(F.col("source_id") / 64).alias("line_id"), F.col("source_id").alias("seq"), F.floor(F.col("l") * 10).cast("long").alias("x"))
    return series.split_seams(rows, 3600.0).select("line_id", "seq", "x", F.col("piece").cast("long").alias("piece"))


def great_circle_points(spark, sf_dir):
    """Points from each source's equatorial to its galactic position as on one sphere, summed up by their number."""
    rows = view(spark, sf_dir, "sources")
    segments = rows.select(F.col("source_id").alias("segment_id"), F.col("ra").alias("ra1"), F.col("dec").alias("dec1"), F.col("l").alias("ra2"), F.col("b").alias("dec2"))
    points = series.great_circle(segments, 10.0)
    return points.groupBy("seq").agg(F.count("*").alias("n"), F.round(F.avg("dec"), 6).alias("mean_dec"), F.round(F.avg(F.sin(F.radians("ra"))), 8).alias("mean_sin"), F.round(F.avg(F.cos(F.radians("ra"))), 8).alias("mean_cos"))


def editorial_axis(spark, sf_dir):
    """The frames of a video over the events' activity window."""
    window = events.activity_window(events.choose_level(_events(spark, sf_dir)))
    axis = behaviour.editorial_axis(spark, 0.0, 1.0, 1000)
    rows = axis.crossJoin(F.broadcast(window)).withColumn("day", F.col("start") + F.col("progress") * (F.col("stop") - F.col("start")))
    return _tidy(rows.select("frame", "seconds", "progress", "opacity", "day"), 6)


QUERIES = {f.__name__: f for f in (ml_set_summary, ml_filters, ml_masses, ml_export_csv, ml_export_json, comparison_csv, peak_percentiles, scenario_draws, ml_rejects, ml_events, ml_index, ml_meta, ml_filter_strong, ml_mass_scenarios, ml_level_choice, ml_source_colour, ml_activity_window, ml_frames, ml_region_frames, ml_images, envelope, peaks, bright_phase, interp_at, polyline_seams, great_circle_points, editorial_axis)}

_E = ctes("sources", "vari_microlensing") + """, ev as (select v.*, l, b, parallax, parallax_error, phot_g_mean_mag, bp_rp, teff_gspphot, ebpminrp_gspphot, v.source_id as seq from vari_microlensing v left join sources s using (source_id)),
ok as (select *, abs(paczynski0_u0) as u0, paczynski0_te as te, paczynski0_tmax as tmax, case when parallax > 0 then parallax end as p, case when parallax_error > 0 then parallax_error end as e from ev
 where l is not null and b is not null and paczynski0_tmax is not null and paczynski0_te > 0 and paczynski0_u0 is not null and l between 0 and 360 and b between -90 and 90),
am as (select *, (g2+2)/sqrt(g2*(g2+4)) as a_max, 1000/p as dist from (select *, greatest(u0*u0, 2.2250738585072014e-308) as g2 from ok)),
"""
_MASS = lambda v, f: f"(pow(299792458e0,2)*pow({v}*1e3*te*864e2,2)*(1/(dist*3.085677581491367e16*{f}*(1-{f})))/(4*6.6743e-11)/1.98847e30)"
_E += f"ms as (select *, {_MASS('1e2', '5e-1')} as mass, case when dist is null then 'missing' else 'model' end as status from am)"
_DAY = "strftime(make_timestamp(cast(floor(((tmax + 2455197.5e0 - 1.550519768e-8*(tmax + 2455197.5e0 - 2443144.5003725e0)) - 2440587.5e0)*86400 - 32.184e0 - 6.55e-5 - (case when tmax > 2557 then 37 when tmax > 2007 then 36 when tmax > 911.5e0 then 35 else 34 end)) as bigint)*1000000), '%Y-%m-%d')"
_LV = _E + """, lv as (select *, coalesce(paczynski1_tmax is not null and paczynski1_te > 0 and paczynski1_u0 is not null and paczynski1_fs_g > 0, false) as v1 from ev),
ch as (select source_id, l, b, teff_gspphot, v1::int as level, case when v1 then paczynski1_tmax else paczynski0_tmax end as tmax, case when v1 then paczynski1_te else paczynski0_te end as te, abs(case when v1 then paczynski1_u0 else paczynski0_u0 end) as u0, case when v1 then least(paczynski1_fs_g, 1e0) else 1e0 end as share from lv),
cl as (select * from ch where tmax is not null and te > 0 and u0 is not null and l is not null and b is not null),
pk as (select *, (g2+2)/sqrt(g2*(g2+4)) as pa from (select *, greatest(u0*u0, 2.2250738585072014e-308) as g2 from cl))"""
_WIN = """, vis as (select *, share*greatest(pa-1,0e0) >= 5e-2 as vis from pk), kp as (select * from vis where vis or not (select bool_or(vis) from vis)),
cp as (select quantile_cont(te, 0.95) as cap from kp), win as (select max(cap) as cap, min(tmax - least(te, cap)) as start, max(tmax + least(te, cap)) as stop from kp, cp)"""
_PS = ctes("photometry_samples")
_MN = _PS + ", mn as (select series, band, t_days, min(mag) as mag from photometry_samples group by all)"
_CT = lambda c: f"(4.6e3*(1/(9.2e-1*least(greatest({c},-5e-1),4e0)+1.7e0)+1/(9.2e-1*least(greatest({c},-5e-1),4e0)+6.2e-1)))"

_CM = _E.replace("ev as (select v.*,", "ev as (select v.*, case when v.source_id % 3 = 0 then paczynski1_bp0 - 16 end as cat,") + """, cm as (select *, case when cat > 0 then cat end as cmass, case when cat > 0 then 'catalog' when dist is not null then 'model' else 'missing' end as st, case when cat > 0 then cat when dist is not null then mass end as lm from ms)"""
_RJ = """al as (select *, seq as k from ev union all select *, seq + 1 as k from ev where source_id % 5 = 0),
r as (select *, case when l is null or b is null or paczynski0_tmax is null or paczynski0_te is null or paczynski0_u0 is null then 'missing parameter' when not (l between 0 and 360 and b between -90 and 90) then 'coordinates out of range' when paczynski0_te <= 0 then 'timescale not positive' end as bad from al),
s as (select coalesce(bad, case when row_number() over (partition by source_id, bad is null order by k) > 1 then 'duplicate id' else 'accepted' end) as reason from r)"""
_CATEGORY = "case when lm between 1e-6 and 1.3e-2 then 'free-floating-planet' when lm between 1 and 2.5e0 then 'neutron-star' when lm between 2.5e0 and 120 then 'black-hole' end"


def _filters_sql() -> str:
    rules = {"all": "true", "strong": "a_max >= 2", "short": "te <= 30", "long": "te >= 100", "catalogue_mass": "st = 'catalog'", "model_mass": "st = 'model'"}
    one = "select '{k}' as kind, '{t}' as text, count(*) as n, sum(source_id)::bigint as ids from nm where {r} and (source_id::varchar like '%{t}%' or lower(name) like '%{t}%')"
    return _CM + ", nm as (select *, 'ML-' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') as name from (select *, row_number() over (order by tmax, seq) as i from cm)) " + " union all ".join(one.format(k=k, t=t, r=r) for k, r in rules.items() for t in ("", "7", "ml-00"))


_SIZE = "least(greatest(sqrt((10 + 1e4*ln(1+m))/pi())*(200e0/72)/3*least(greatest(drawn,3e-1),5e0)*(4320e0/4320), 2e0), 4320*8e-2)"

ORACLE = {
    "ml_region_frames": _LV + f""", rg as (select p.*, coalesce(case when p.source_id % 3 = 0 then v.paczynski1_bp0 - 14 end, 1e0) as drawn from pk p join vari_microlensing v using (source_id) where abs(((l - 3.23e0 + 180) % 360 + 360) % 360 - 180) <= 5.635e1 and b between 5.9e-1 - 2.819e1 and 5.9e-1 + 2.819e1),
f as (select *, unnest([tmax - te, tmax, 2200e0]) as t from rg), g as (select *, (w+2)/sqrt(w*(w+4)) as a from (select *, greatest(u0*u0 + pow((t-tmax)/te,2), 2.2250738585072014e-308) as w from f)),
h as (select *, least(greatest(share,0e0),1e0)*greatest(a-1,0e0) as s, greatest(least(greatest(share,0e0),1e0)*(pa-1),0e0) as m from g),
k as (select *, case when m > 0 then least(greatest(ln(1+s)/ln(1+m),0e0),1e0) else 0e0 end as p, 2e0*4320/8192 as base, least(greatest(5e-1 + 5e-1*ln(1+m)/ln(1e1),5e-1),1e0) as top from h)
select source_id, round(t,6) as t, round(drawn,6) as drawn, round(s,6) as strength, round(base + ({_SIZE} - base)*p,6) as sigma, round(2e-1 + (top - 2e-1)*p,6) as alpha from k""",
    "ml_set_summary": _CM + ", " + _RJ + f""", rs as (select reason, count(*) as n from s where reason <> 'accepted' group by 1)
select count(*) as n, min({_DAY}) as first_date, max({_DAY}) as last_date, round(quantile_cont(te, 0.5),7) as median_te, count(*) filter (where a_max >= 2) as strong, count(*) filter (where st = 'catalog') as mass_catalog, count(*) filter (where st = 'model') as mass_model, count(*) filter (where st = 'missing') as mass_missing, count(e) as with_parallax_error,
 (select count(*) from s) as n_input, (select sum(n)::bigint from rs) as n_rejected, (select '{{' || string_agg('"' || reason || '":' || n, ',' order by reason) || '}}' from rs) as reasons from cm""",
    "ml_filters": _filters_sql(),
    "ml_masses": _CM + f" select source_id, st as mass_status, case when cmass is not null then 'paczynski_mass' end as mass_origin, {_CATEGORY} as lens_category, round(log10(lm),8) as mass, round(coalesce(cat, 1e0),9) as drawn, case when teff_gspphot is not null then 'Gaia teff_gspphot' when bp_rp is not null then 'estimate from BP-RP' end as temperature_origin from cm",
    "ml_export_csv": _E + " select 'ML-' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') as name, source_id as sourceId, round(l,7) as l, round(b,7) as b, round(tmax,7) as tmax, round(te,7) as te, round(u0,7) as u0, round(a_max,7) as aMax, round(p,7) as parallax, round(e,7) as parallaxError, round(dist,7) as distancePc, round(log10(case when dist is not null then mass end),7) as lensMass, status as massStatus from (select *, row_number() over (order by tmax, seq) as i from ms)",
    "ml_export_json": _E + f" select source_id, round(te,9) as te, {_DAY} as date, status as mass_status from ms",
    "comparison_csv": _PS + "select series as scenario, band as filter, t_days as observer_time_days, count(*) as n, round(avg(mag),7) as mag, round(avg(mag - 5*log10(1e2) + 5),7) as abs_mag, round(avg(flux),6) as flux, round(5e3 + t_days,6) as temperature_k, round(t_days,6) as radius_gm from photometry_samples group by series, band, t_days",
    "peak_percentiles": _PS + """, p as (select series, band, sample, arg_min(t_days, row(mag, t_days)) as t, min(mag) as m from photometry_samples group by all),
u as (select series, band, 'time' as of, t as v from p union all select series, band, 'value', m from p) select series, band, of, round(quantile_cont(v,0.05),7) as p05, round(quantile_cont(v,0.5),7) as p50, round(quantile_cont(v,0.95),7) as p95 from u group by series, band, of""",
    "scenario_draws": _PS + f"""k as (select distinct series, sample, cast(substr(series, 4) as bigint) * 100000 + sample as hk from photometry_samples), d as (select series, sample, 1e1 + 1e1*{_uniform('hk', 1000)} as a, 9e0 + 9e0*{_uniform('hk', 1002)} as b, 5e-1 + {_uniform('hk', 1004)} as e from k)
select series, sample, round(a,9) as initial_mass_solar, round(case when b > a then 9.7e-1*a else b end,9) as final_mass_solar, round(e,9) as energy_foe from d""".replace("k as (", ", k as (", 1),
    "ml_rejects": _E + """, al as (select *, seq as k from ev union all select *, seq + 1 as k from ev where source_id % 5 = 0),
r as (select *, case when l is null or b is null or paczynski0_tmax is null or paczynski0_te is null or paczynski0_u0 is null then 'missing parameter' when not (l between 0 and 360 and b between -90 and 90) then 'coordinates out of range' when paczynski0_te <= 0 then 'timescale not positive' end as bad from al),
s as (select coalesce(bad, case when row_number() over (partition by source_id, bad is null order by k) > 1 then 'duplicate id' else 'accepted' end) as reason from r) select reason, count(*) as n from s group by 1""",
    "ml_events": _E + f""", hx as (select *, -radians(((l+180)%360+360)%360-180) as lo, radians(b) as la from ms)
select source_id, round(te,7) as te, round(tmax,7) as tmax, round(u0,7) as u0, round((cos(la)*sin(lo/2)/sqrt(1+cos(la)*cos(lo/2))+1)/2,7) as x, round((1-sin(la)/sqrt(1+cos(la)*cos(lo/2)))/2,7) as y, round(a_max,7) as a_max, round(dist,7) as distance_pc, round(case when p > e then 1000/(p-e) end,7) as distance_high_pc, status as mass_status,
 case when mass between 1e-6 and 1.3e-2 then 'free-floating-planet' when mass between 1 and 2.5e0 then 'neutron-star' when mass between 2.5e0 and 120 then 'black-hole' end as lens_category,
 case when teff_gspphot is null then null when teff_gspphot >= 30000 then 'O' when teff_gspphot >= 10000 then 'B' when teff_gspphot >= 7500 then 'A' when teff_gspphot >= 6000 then 'F' when teff_gspphot >= 5200 then 'G' when teff_gspphot >= 3700 then 'K' else 'M' end as spectral, {_DAY} as peak_date from hx""",
    "ml_index": _E + "select source_id, i as catalogue_index, 'ML-' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') as name from (select source_id, row_number() over (order by tmax, seq) as i from ok)",
    "ml_meta": _E + f"select count(*) as n, min({_DAY}) as first_date, max({_DAY}) as last_date, round(quantile_cont(te, 0.5),7) as median_te, count(*) filter (where a_max >= 2) as strong, 0::bigint as mass_catalog, count(*) filter (where status = 'model') as mass_model, count(*) filter (where status = 'missing') as mass_missing, count(e) as with_parallax_error from ms",
    "ml_filter_strong": _E + "select source_id from am where a_max >= 2 and source_id::varchar like '%7%'",
    "ml_mass_scenarios": _E + f"select source_id, round(log10(mass),8) as mass, round(log10({_MASS('5e1','5e-1')}),8) as low, round(log10({_MASS('2e2','2.5e-1')}),8) as high, round(log10(mass*pow(1.5e0,2)*(2.5e-1/(3e-1*7e-1))),8) as scaled from ms where dist is not null",
    "ml_level_choice": _LV + " select source_id, level, round(tmax,9) as tmax, round(te,9) as te, round(u0,9) as u0, round(share,9) as share from cl",
    "ml_source_colour": ctes("sources", "vari_microlensing", "astrophysical_parameters") + f""", j as (select v.source_id, teff_gspphot as teff, bp_rp, case when abp_gspphot - arp_gspphot >= 0 then abp_gspphot - arp_gspphot when ebpminrp_gspphot >= 0 then ebpminrp_gspphot end as red,
 case when paczynski1_tmax is not null and paczynski1_te > 0 and paczynski1_u0 is not null and paczynski1_fs_g > 0 and paczynski1_fs_bp > 0 and paczynski1_fs_rp > 0 then paczynski1_bp0 - paczynski1_rp0 - 2.5e0*log10(paczynski1_fs_bp/paczynski1_fs_rp) end as src
 from vari_microlensing v left join sources using (source_id) left join astrophysical_parameters using (source_id))
select source_id, round(case when src - red is not null then {_CT('(src-red)')} when teff is not null then teff when bp_rp - red is not null then {_CT('(bp_rp-red)')} when src is not null then {_CT('src')} when bp_rp is not null then {_CT('bp_rp')} else 5772e0 end, 6) as kelvin,
 case when src - red is not null then 'source_intrinsic' when teff is not null then 'teff' when bp_rp - red is not null then 'catalog_intrinsic' when src is not null then 'source_observed' when bp_rp is not null then 'catalog_observed' else 'solar' end as origin from j""",
    "ml_activity_window": _LV + _WIN + " select round(cap,6) as cap, round(start,6) as start, round(stop,6) as stop from win",
    "ml_frames": _LV + """, f as (select *, 1700e0 + i*100e0 as t from pk, range(10) r(i)), g as (select *, (w+2)/sqrt(w*(w+4)) as a from (select *, greatest(u0*u0 + pow((t-tmax)/te,2), 2.2250738585072014e-308) as w from f)),
h as (select i, share*greatest(a-1,0e0) as s, share*greatest(pa-1,0e0) as m from g),
k as (select i, m, case when m > 0 then least(greatest(ln(1+s)/ln(1+m),0e0),1e0) else 0e0 end as p from h)
select i::int as frame, count(*) as n, round(avg(2 + (least(greatest(sqrt((10+10000*ln(1+m))/pi())*(200/72e0)/3*(8192/4320e0),2e0),655.36e0)-2)*p),6) as mean_sigma, round(avg(2e-1+(least(greatest(5e-1+5e-1*ln(1+m)/ln(10e0),5e-1),1e0)-2e-1)*p),6) as mean_alpha from k group by i""",
    "ml_images": _LV + " select source_id, round((u0+sqrt(u0*u0+4))/2,7) as theta_plus, round((u0-sqrt(u0*u0+4))/2,7) as theta_minus, round(((u0*u0+2)/(u0*sqrt(u0*u0+4))+1)/2,7) as mu_plus, round(((u0*u0+2)/(u0*sqrt(u0*u0+4))-1)/2,7) as mu_minus, round((u0*u0+2)/(u0*sqrt(u0*u0+4)),7) as mu_total from cl where u0 > 0",
    "envelope": _PS + "select series, band, round(t_days,7) as t_days, round(quantile_cont(mag,0.05),7) as p05, round(quantile_cont(mag,0.5),7) as p50, round(quantile_cont(mag,0.95),7) as p95 from photometry_samples group by series, band, t_days",
    "peaks": _PS + "select series, band, sample, round(t_days,7) as peak_time, round(mag,7) as peak_value from (select *, row_number() over (partition by series, band, sample order by mag, t_days) as r from photometry_samples) where r = 1",
    "bright_phase": _MN + """, p as (select *, first_value(mag) over w as pm, first_value(t_days) over w as pt from mn window w as (partition by series, band order by mag, t_days)),
q as (select *, row_number() over (partition by series, band order by t_days) as i, row_number() over (partition by series, band, mag <= pm + 1.5e0 order by t_days) as j from p)
select series, band, min(t_days) as start, max(t_days) as stop from q where mag <= pm + 1.5e0 group by series, band, i - j having bool_or(t_days = pt)""",
    "interp_at": _MN + """, w as (select series, band, i*47.3e0 as t from (select distinct series, band from mn), range(-1, 12) r(i)),
x as (select w.*, (select max(t_days) from mn m where m.series = w.series and m.band = w.band and t_days <= t) as lo, (select min(t_days) from mn m where m.series = w.series and m.band = w.band and t_days >= t) as hi from w)
select x.series, x.band, round(t,6) as at, round(case when lo is null then b.mag when hi is null or lo = hi then a.mag else a.mag + (b.mag-a.mag)*(t-lo)/(hi-lo) end,6) as value
from x left join mn a on a.series = x.series and a.band = x.band and a.t_days = lo left join mn b on b.series = x.series and b.band = x.band and b.t_days = hi""",
    "polyline_seams": ctes("sources") + """, p as (select source_id // 64 as line_id, source_id as seq, floor(l*10)::bigint as x from sources), j as (select *, case when abs(x - lag(x) over (partition by line_id order by seq)) > 900 then 1 else 0 end as jump from p),
k as (select *, (sum(jump) over (partition by line_id order by seq))::bigint as piece from j) select line_id, seq, x, piece from (select *, count(*) over (partition by line_id, piece) as n from k) where n >= 2""",
    "great_circle_points": ctes("sources") + """, s as (select source_id as segment_id, radians(ra) as a1, radians(dec) as d1, radians(l) as a2, radians(b) as d2 from sources),
g as (select *, acos(least(greatest(sin(d1)*sin(d2)+cos(d1)*cos(d2)*cos(a1-a2),-1e0),1e0)) as w from s), n as (select *, greatest(1, ceil(degrees(w)/10))::bigint as m from g),
q as (select *, unnest(range(m+1)) as seq from n), u as (select *, case when w >= 1e-9 then sin((1-seq/m::double)*w)/sin(w) else 1-seq/m::double end as k1, case when w >= 1e-9 then sin(seq/m::double*w)/sin(w) else seq/m::double end as k2 from q),
v as (select *, k1*cos(d1)*cos(a1)+k2*cos(d2)*cos(a2) as x, k1*cos(d1)*sin(a1)+k2*cos(d2)*sin(a2) as y, k1*sin(d1)+k2*sin(d2) as z from u)
select seq::int as seq, count(*) as n, round(avg(degrees(asin(least(greatest(z/sqrt(x*x+y*y+z*z),-1e0),1e0)))),6) as mean_dec, round(avg(y/sqrt(x*x+y*y)),8) as mean_sin, round(avg(x/sqrt(x*x+y*y)),8) as mean_cos from v group by seq""",
    "editorial_axis": _LV + _WIN + """ select i::int as frame, round(i/25e0,6) as seconds, round(p,6) as progress, round(case when i/25e0 >= 3 and i/25e0 < 38 then least(least(greatest((i/25e0-3)/5e-1,0e0),1e0), least(greatest((38-i/25e0)/5e-1,0e0),1e0)) else 0e0 end,6) as opacity, round(start + p*(stop-start),6) as day
from (select i, least(greatest((i/25e0-3)/35,0e0),1e0) as p from range(1000) r(i)), win""",
}
