"""Queries on catalogues, samples and light curves, with the SQL they are compared with."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import ctes, view
from ..functions import coords, photometry
from ..functions.hashing import uniform
from ..operators import behaviour, catalogue, coverage, sampling
from ..workspace import fresh_dir, written

TAU = 2.0 * math.pi


def _tidy(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*(F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _study(spark, sf_dir, table, spec, subclass):
    v = lambda n: view(spark, sf_dir, n)
    return _tidy(catalogue.study_catalogue(v(table), v("sources"), v("vari_summary"), spec, subclass), 7)


def _classified(spark, sf_dir, spec):
    v = lambda n: view(spark, sf_dir, n)
    return _tidy(catalogue.classifier_catalogue(v("vari_classifier_result"), v("sources"), v("vari_summary"), spec, 0.2), 7)


def cat_rr_lyrae(spark, sf_dir):
    return _study(spark, sf_dir, "vari_rrlyrae", catalogue.RR_LYRAE, "best_classification")


def cat_cepheids(spark, sf_dir):
    return _study(spark, sf_dir, "vari_cepheid", catalogue.CEPHEIDS, "type_best_classification")


def cat_lbv(spark, sf_dir):
    return _classified(spark, sf_dir, catalogue.LBV)


def cat_cataclysmic(spark, sf_dir):
    return _classified(spark, sf_dir, catalogue.CATACLYSMIC)


def cat_zz_ceti(spark, sf_dir):
    return _classified(spark, sf_dir, catalogue.ZZ_CETI)


def cat_other(spark, sf_dir):
    return _classified(spark, sf_dir, catalogue.OTHER)


def cat_microlensing(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    rows = catalogue.microlensing_catalogue(v("vari_microlensing"), v("sources"), v("astrophysical_parameters"))
    return _tidy(rows.select("source_id", "l", "b", "parallax", "paczynski0_tmax", "paczynski0_te", "paczynski0_u0", "azero_gspphot", "abp_gspphot", "arp_gspphot"), 7)


def cat_selection(spark, sf_dir):
    """Three catalogues chosen by name, one of them twice, and the rest: rows and least and greatest ids of each."""
    tables = {n: view(spark, sf_dir, n) for n in ("sources", "vari_summary", "vari_rrlyrae", "vari_cepheid", "vari_classifier_result")}
    found = None
    for name, rows in catalogue.build_catalogues(catalogue.choose_catalogues(["lbv", "rr_lyrae", "lbv", "zz_ceti"], include_other=True), tables, 0.2, 400).items():
        one = rows.groupBy(F.lit(name).alias("catalogue"), "variable_class").agg(F.count("*").alias("n"), F.sum("source_id").alias("ids"), F.max("random_index").alias("last"))
        found = one if found is None else found.unionByName(one)
    return found


def top_by_random_index(spark, sf_dir):
    rows = written(view(spark, sf_dir, "sources").select("source_id", "random_index"), "indexed")
    return catalogue.first_by(rows, "random_index", 500)


def index_range(spark, sf_dir):
    rows = catalogue.index_range(view(spark, sf_dir, "sources"), 200_000, 400_000)
    return _tidy(rows.select("source_id", "random_index", "l", "b", "phot_g_mean_mag"))


def region_filter(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").filter(coords.Region().inside(F.col("l"), F.col("b")))
    return _tidy(rows.select("source_id", "l", "b"))


def cone_membership(spark, sf_dir):
    rows = view(spark, sf_dir, "sources")
    return rows.groupBy(coords.in_cones(F.col("l"), F.col("b")).alias("in_cone"), coords.magellanic_member(F.col("l"), F.col("b"), F.col("parallax")).alias("member")).agg(F.count("*").alias("n"))


def _sorted_sky(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").select("source_id", "l", "b", "phot_g_mean_mag")
    coverage.save_sorted(rows, path := fresh_dir(spark, "sky"), group_bytes=1 << 20)
    return path


def region_scan(spark, sf_dir):
    """region_filter over a table sorted by pixel: only the ranges of the region's cover are read."""
    box = coverage.Box(coords.Region())
    return _tidy(coverage.read_inside(spark, _sorted_sky(spark, sf_dir), [box]).select("source_id", "l", "b"))


def cone_scan(spark, sf_dir):
    """The stars of both clouds' cones and of a small one around a pole, from the same kind of table."""
    cones = [*(coverage.Cone(*c) for c in coords.MAGELLANIC), coverage.Cone(0.0, 90.0, 5.0)]
    return _tidy(coverage.read_inside(spark, _sorted_sky(spark, sf_dir), cones).select("source_id", "l", "b", "phot_g_mean_mag"))


def observability(spark, sf_dir):
    return view(spark, sf_dir, "sources").groupBy(coords.observability(F.col("dec")).alias("class")).agg(F.count("*").alias("n"))


def frame_transform(spark, sf_dir):
    rows = view(spark, sf_dir, "sources")
    l, b = coords.icrs_to_galactic(F.col("ra"), F.col("dec"))
    return rows.select("source_id", F.round(l, 6).alias("gl"), F.round(b, 6).alias("gb"))


def distances(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").withColumns(photometry.distance_columns(F.col("parallax"), F.col("parallax_error")))
    m = photometry.absolute_magnitude(F.col("phot_g_mean_mag"), F.col("parallax"), F.col("parallax_error"))
    return _tidy(rows.select("source_id", "distance_pc", "distance_low_pc", "distance_high_pc", "parallax_relative_error", m.alias("abs_g")), 6)


def star_colours(spark, sf_dir):
    rows = view(spark, sf_dir, "sources").withColumn("t", photometry.temperature(F.col("teff_gspphot"), F.col("bp_rp")))
    r, g, b = photometry.black_body_rgb(F.col("t"))
    vr, vg, vb = photometry.vivid_rgb(F.col("t"))
    return _tidy(rows.select("source_id", F.col("t").alias("kelvin"), r.alias("r"), g.alias("g"), b.alias("b"), vr.alias("vr"), vg.alias("vg"), vb.alias("vb"), photometry.spectral_letter(F.col("t")).alias("letter")), 10)


def stable_uniform(spark, sf_dir):
    rows = view(spark, sf_dir, "sources")
    return rows.select("source_id", *(uniform(F.col("source_id"), s).alias(f"u{s}") for s in (42, 57721)))


def _classes(spark, sf_dir):
    stars = view(spark, sf_dir, "sources").select("source_id", "l", "b", "parallax", "teff_gspphot", "bp_rp", "phot_g_mean_mag")
    return stars.join(view(spark, sf_dir, "vari_classifier_result").withColumnRenamed("best_class_name", "cls"), "source_id")


def bucket_caps(spark, sf_dir):
    rows = _classes(spark, sf_dir).withColumn("bucket", sampling.bucket()).filter("bucket is not null")
    return sampling.cap(rows, 60, "cls", "bucket").select("cls", "bucket", "source_id")


def sky_balanced_sample(spark, sf_dir):
    rows = _classes(spark, sf_dir).withColumn("bucket", sampling.bucket()).filter("bucket = 'galactic'")
    return sampling.sky_balanced(rows, 300).select("source_id", "cls", "zone")


def magellanic_cap(spark, sf_dir):
    rows = _classes(spark, sf_dir).withColumn("bucket", sampling.bucket()).filter("bucket is not null")
    return sampling.magellanic_cap(rows).select("source_id", "cls", "bucket")


def _stars(spark, sf_dir):
    rows = _classes(spark, sf_dir).join(view(spark, sf_dir, "vari_summary"), "source_id", "left")
    return rows.withColumn("period", F.lit(None).cast("double")).withColumn("amplitude", F.col("trimmed_range_mag_g_fov")).withColumn("phase", catalogue.phase_of_id(F.col("source_id")))


def behaviour_params(spark, sf_dir):
    rows = behaviour.with_parameters(behaviour.with_behaviour(_stars(spark, sf_dir)))
    return _tidy(rows.select("source_id", "behaviour_class", "model", "flux_mode", "used_period", "used_amplitude", "used_phase", "event_centre", "used_irregularity", "event_width", "event_shape"), 7)


def light_curve_frames(spark, sf_dir):
    """Every star at eight epochs, summed up by class and frame."""
    stars = behaviour.with_parameters(behaviour.with_behaviour(_stars(spark, sf_dir)))
    stars = stars.withColumn("temperature", photometry.temperature(F.col("teff_gspphot"), F.col("bp_rp"), photometry.VARIABLE_FALLBACK_K))
    epochs = spark.range(8).select(F.col("id").cast("int").alias("frame"), (F.col("id") * 17.25).alias("elapsed"), (F.col("id") / 7.0).alias("progress"), F.lit(1.0).alias("opacity"))
    rows = behaviour.frames(stars, epochs)
    return rows.groupBy("behaviour_class", "frame").agg(F.count("*").alias("n"), F.round(F.avg("relative_flux"), 6).alias("mean_flux"), F.round(F.avg("sigma"), 6).alias("mean_sigma"), F.round(F.avg("alpha"), 6).alias("mean_alpha"), F.round(F.avg("green"), 6).alias("mean_green"))


def schema_union(spark, sf_dir):
    """Two catalogues of different columns in one."""
    a = view(spark, sf_dir, "vari_rrlyrae").select("source_id", "pf", F.lit("rr").alias("origin"))
    b = view(spark, sf_dir, "vari_cepheid").select("source_id", "p1_o", F.lit("cep").alias("origin"))
    return catalogue.aligned_union([a, b]).groupBy("origin").agg(F.count("*").alias("n"), F.count("pf").alias("n_pf"), F.count("p1_o").alias("n_p1"))


def missing_ids(spark, sf_dir):
    stars = view(spark, sf_dir, "sources").select("source_id")
    return catalogue.select_ids(stars, view(spark, sf_dir, "vari_microlensing").select("source_id"))[1]


QUERIES = {f.__name__: f for f in (cat_rr_lyrae, cat_cepheids, cat_lbv, cat_cataclysmic, cat_zz_ceti, cat_other, cat_microlensing, cat_selection, top_by_random_index, index_range, region_filter, region_scan, cone_membership, cone_scan, observability, frame_transform, distances, star_colours, stable_uniform, bucket_caps, sky_balanced_sample, magellanic_cap, behaviour_params, light_curve_frames, schema_union, missing_ids)}

_S = ctes("sources")
_SRC = "s.source_id, round(l,7) as l, round(b,7) as b, round(parallax,7) as parallax, round(parallax_error,7) as parallax_error, round(phot_g_mean_mag,7) as phot_g_mean_mag, round(teff_gspphot,7) as teff_gspphot, round(bp_rp,7) as bp_rp, random_index"


def _study_sql(table: str, default: float, cls: str, label: str, sub: str) -> str:
    period = f"case when pf > 0 then pf when p1_o > 0 then p1_o else {default}e0 end"
    return ctes("sources", "vari_summary", table) + f"""select {_SRC}, round({period}, 7) as period,
 round(case when peak_to_peak_g > 0 then peak_to_peak_g when trimmed_range_mag_g_fov > 0 then trimmed_range_mag_g_fov else 1e0 end, 7) as amplitude,
 round(case when epoch_g is null then 0e0 else (2*pi()*epoch_g/({period})) % (2*pi()) end, 7) as phase, '{cls}' as variable_class,
 case when trim({sub}) <> '' then trim({sub}) else '{label}' end as variable_subclass, cast(null as double) as classification_score
from {table} v join sources s using (source_id) left join vari_summary y using (source_id) where l is not null and b is not null"""


def _class_sql(where: str, default: float, cls: str) -> str:
    return ctes("sources", "vari_summary", "vari_classifier_result") + f"""select {_SRC}, {default}e0 as period,
 round(case when trimmed_range_mag_g_fov > 0 then trimmed_range_mag_g_fov else 1e0 end, 7) as amplitude, round((s.source_id % 1000003) / 1000003e0 * 2 * pi(), 7) as phase,
 {cls} as variable_class, trim(best_class_name) as variable_subclass, round(best_class_score, 7) as classification_score
from vari_classifier_result c join sources s using (source_id) left join vari_summary y using (source_id) where {where} and best_class_score >= 2e-1 and l is not null and b is not null"""


_COS = lambda l0, b0: f"(sin(radians(b))*sin(radians({b0})) + cos(radians(b))*cos(radians({b0}))*cos(radians(l)-radians({l0})))"
_CONE = f"coalesce({_COS(280.4652, -32.8884)} >= cos(radians(12e0)) or {_COS(302.8084, -44.3277)} >= cos(radians(8e0)), false)"
_MEMBER = f"({_CONE} or coalesce(parallax between 0 and 2e-2, false))"
_BUCKET = f"case when {_MEMBER} then 'magellanic' when parallax > 2e-2 then 'galactic' end"
_MOD = "% 18446744073709551616::uhugeint"


def _hash(expr: str, seed: int) -> str:
    """The mixing function in 128-bit arithmetic."""
    a = f"xor({expr}::uhugeint, {seed}::uhugeint)"
    b = f"(xor({a}, {a} >> 30) * 13787848793156543929::uhugeint {_MOD})"
    return f"(select xor(q, q >> 31) >> 40 from (select (xor(p, p >> 27) * 10723151780598845931::uhugeint {_MOD}) as q from (select {b} as p)))"


def _uniform(expr: str, seed: int) -> str:
    return f"({_hash(expr, seed)}::double / 16777216e0)"


_CLASSES = "k as (select source_id, l, b, parallax, teff_gspphot, bp_rp, phot_g_mean_mag, best_class_name as cls, best_class_score from sources join vari_classifier_result using (source_id))"
_C = ctes("sources", "vari_classifier_result")
_ZONE = "case when abs(b) <= 12 and abs((l + 180) % 360 - 180) <= 25 then 'centre' when abs(b) <= 15 then 'disk' when abs(b) <= 45 then 'mid' else 'halo' end"
_TEMP = lambda f: f"coalesce(teff_gspphot, case when bp_rp is not null then 4.6e3*(1/(9.2e-1*least(greatest(bp_rp,-5e-1),4e0)+1.7e0)+1/(9.2e-1*least(greatest(bp_rp,-5e-1),4e0)+6.2e-1)) end, {f})"
_ROT = coords.ICRS_TO_GALACTIC
_XYZ = [f"({m[0]!r}*cos(radians(dec))*cos(radians(ra)) + {m[1]!r}*cos(radians(dec))*sin(radians(ra)) + {m[2]!r}*sin(radians(dec)))" for m in (tuple(f"{v:.16e}" for v in row) for row in _ROT)]
_XYZ = [x.replace("'", "") for x in _XYZ]


def _behaviour_values() -> str:
    return "beh(cls, model, flux_mode, p0, a0, floor_, irr, tr, ss, sr, ii, br, ceil_, w0, w1) as (values " + ", ".join("('{}', '{}', '{}', {})".format(*r[:3], ", ".join(f"{v!r}::double" for v in r[3:])) for r in behaviour.BEHAVIOUR) + ")"


_STAR = f"""{_CLASSES}, {_behaviour_values()},
st as (select k.*, m.trimmed_range_mag_g_fov as amp, case when n.cls is null then 'OTHER' else n.cls end as bc from
 (select *, case cls when 'RR' then 'RR_LYRAE' when 'CEP' then 'CEPHEIDS' when 'WD' then 'ZZ_CETI' when 'CV' then 'CATACLYSMIC' else cls end as nm from k) k
 left join vari_summary m using (source_id) left join (select cls from beh) n on n.cls = k.nm),
h as (select st.*, {_uniform('source_id', 57721)} as u1, {_uniform('source_id', 31415)} as u2, {_uniform('source_id', 16180)} as u3, {_uniform('source_id', 27182)} as u4, {_uniform('source_id', 27182 ^ 16180)} as u5, {_uniform('source_id', 27182 ^ 31415)} as u6 from st),
par as (select h.*, beh.* exclude (cls), p0 as per, least(greatest(case when amp >= 0 then amp else a0 end, floor_), ceil_) as am,
 ((source_id % 1000003)/1000003e0*2*pi() + 2*pi()*u1) % (2*pi()) as ph, 2.4e-1+5.2e-1*u4 as ec, irr*(7.5e-1+5e-1*u3) as ir, w0+(w1-w0)*u5 as ew, u6 as es, 2*pi()*u2 as q1, 2*pi()*u3 as q2 from h join beh on beh.cls = h.bc)"""
_P = ctes("sources", "vari_classifier_result", "vari_summary") + ", " + _STAR


def _lattice(cell: str, seed: str) -> str:
    a = f"xor(({cell})::bigint::uhugeint, (({seed})::uhugeint + 11400714819323198485::uhugeint) {_MOD})"
    b = f"(xor({a}, {a} >> 30) * 13787848793156543929::uhugeint {_MOD})"
    return f"((select xor(q, q >> 31) >> 40 from (select (xor(p, p >> 27) * 10723151780598845931::uhugeint {_MOD}) as q from (select {b} as p)))::double / 16777216e0)"


_SM = lambda v: f"(least(greatest({v},0e0),1e0)*least(greatest({v},0e0),1e0)*(3-2*least(greatest({v},0e0),1e0)))"
_NOISE = lambda pos, seed: f"({_lattice(f'floor({pos})', seed)} + ({_lattice(f'floor({pos})+1', seed)} - {_lattice(f'floor({pos})', seed)})*{_SM(f'({pos})-floor({pos})')})"
_FR = f"""e as (select i as frame, i*1.725e1 as el, i/7e0 as pr from range(8) r(i)),
c as (select par.*, e.*, (ph/(2*pi()) + el/per) % 1 as x, floor(q1/(2*pi())*16777216e0)::bigint as sd from par, e),
pos as (select *, q2/(2*pi())*4096e0 + pr*(12+20*es) as s1, q2/(2*pi())*4096e0*1.731e0 + pr*(12+20*es)*2.37e0 as s2, xor(sd::uhugeint, 15111065706836454659::uhugeint) as sd2 from c),
ev as (select *, (pr-ec)/ew as rel, el/greatest(per,1e-4) as sc, pow(1.2e-1+5.8e-1*es,2) as i2 from pos),
lev as (select *, 7.2e-1*{_NOISE('s1', 'sd')}+2.8e-1*{_NOISE('s2', 'sd2')} as lv, (i2+rel*rel+2)/sqrt((i2+rel*rel)*(i2+rel*rel+4)) as nw, (i2+2)/sqrt(i2*(i2+4)) as pk from ev),
sig as (select *, case model
 when 'rr_lyrae' then case when x < 1.6e-1 then {_SM('x/1.6e-1')} else pow(greatest(1-(x-1.6e-1)/8.4e-1,0e0),7.2e-1) end
 when 'cepheid' then {_SM(f"(case when x < 3.2e-1 then {_SM('x/3.2e-1')} else pow(greatest(1-(x-3.2e-1)/6.8e-1,0e0),9e-1) end)")}
 when 'zz_ceti' then least(greatest(5e-1+5e-1*(sin(2*pi()*x)+3.2e-1*sin(2*pi()*1.071e0*x+q1)+1.8e-1*sin(2*pi()*9.27e-1*x+q2))/1.5e0,0e0),1e0)
 when 'cataclysmic' then case when x < 4.5e-2 then {_SM('x/4.5e-2')} when x < 1.3e-1 then 1e0 when x < 4.3e-1 then pow(1-(x-1.3e-1)/3e-1,1.35e0) else 0e0 end
 when 'eclipsing' then least(greatest(exp(-5e-1*pow(((x+5e-1)%1-5e-1)/4.5e-2,2))+4.8e-1*exp(-5e-1*pow((x%1-5e-1)/6.5e-2,2)),0e0),1e0)
 when 'long_period' then least(greatest(5e-1+5e-1*(sin(2*pi()*x)+2.2e-1*sin(4*pi()*x+q1)+ir*1.8e-1*sin(2*pi()*4.7e-1*x+q2))/1.4e0,0e0),1e0)
 when 'yso_irregular' then least(greatest(2.8e-1*sin(2*pi()*x+q1)+1.6e-1*sin(2*pi()*4.3e-1*x+q2)+7.5e-1*exp(-5e-1*pow(((x-(q1/(2*pi()))%1+1.5e0)%1-5e-1)/3.5e-2,2))-8.5e-1*exp(-5e-1*pow(((x-(q2/(2*pi()))%1+1.5e0)%1-5e-1)/7.5e-2,2)),-1e0),1e0)
 when 'conservative' then 5e-1+5e-1*sin(2*pi()*x) when 'solar_like' then 5e-1+5e-1*sin(2*pi()*x)
 when 'lbv' then least(greatest(5e-1+5e-1*sin(2*pi()*x-5e-1*pi())*(1+ir*2.5e-1*sin(2*pi()*3.7e-1*x+q2))+1e-1*sin(2*pi()*7.3e0*x+q1)+6e-2*sin(2*pi()*1.17e1*x+q2),0e0),1e0)
 when 'stochastic_hot' then {_SM('lv')}
 when 'ellipsoidal' then 5e-1+5e-1*cos(4*pi()*x)
 when 'multimode' then least(greatest(5e-1+5e-1*(sin(2*pi()*x)+2.8e-1*sin(2*pi()*1.043e0*x+q1)+1.6e-1*sin(2*pi()*9.68e-1*x+q2))/1.44e0,0e0),1e0)
 when 'rotational' then least(greatest(5e-1+5e-1*(sin(2*pi()*x)+2.4e-1*sin(4*pi()*x+q1))/1.24e0,0e0),1e0)
 when 'gentle_pulsation' then least(greatest(5e-1+5e-1*(sin(2*pi()*x)+1.2e-1*sin(4*pi()*x+q1))/1.12e0,0e0),1e0)
 when 'rcb_decline' then case when rel < 0 then 0e0 else {_SM('rel/1e-1')}*exp(-greatest(rel-1e-1,0e0)/8e-1) end
 when 'microlensing_event' then least(greatest((nw-1)/(pk-1),0e0),1e0)
 when 'supernova_event' then case when rel < 0 then exp(least(greatest(rel/1.2e-1,-3e1),0e0)) else exp(-greatest(rel,0e0)/1.35e0) end
 when 'agn_noise' then least(greatest(6.2e-1*sin(2*pi()*1.73e-1*sc+q1)+2.7e-1*sin(2*pi()*7.1e-2*sc+q2)+1.1e-1*sin(2*pi()*1.9e-2*sc+q1+q2),-1e0),1e0)
 when 'planet_transit' then exp(-5e-1*pow(((x+5e-1)%1-5e-1)/2.5e-2,2)) end as sg from lev),
dr as (select *, case when model in ('zz_ceti','eclipsing','conservative','ellipsoidal','microlensing_event','rotational','solar_like','agn_noise','planet_transit') then 0e0 when model in ('cataclysmic','rcb_decline') then sg when model = 'supernova_event' then case when rel < 0 then sg else least(greatest(1-7.5e-1*rel,-5.5e-1),1e0) end when model = 'yso_irregular' then exp(-5e-1*pow(((x-(q2/(2*pi()))%1+1.5e0)%1-5e-1)/7.5e-2,2)) else 2*sg-1 end as cd, pow(10e0, 4e-1*least(greatest(am,0e0),8e0)) as fr from sig),
fl as (select *, case flux_mode when 'range' then exp((sg-5e-1)*ln(fr)) when 'outburst' then 1+(fr-1)*least(greatest(sg,0e0),1e0) when 'dimming' then 1-(1-1/fr)*least(greatest(sg,0e0),1e0) when 'signed' then exp(5e-1*sg*ln(fr)) when 'supernova' then 3.5e-2+(fr-3.5e-2)*least(greatest(sg,0e0),1e0) end as rf from dr),
fin as (select *, least(greatest(3.2e0*ss*exp(least(greatest(sr*ln(least(greatest(rf,1e-2),1e2)),-6.5e-1),7.5e-1)),2.2e0),1.25e1) as sigma, least(greatest(5.2e-1*ii*exp(5e-1*least(greatest(br,2.5e-1),6e0)*ln(least(greatest(rf,1e-2),1e2))),1.2e-2),9.5e-1) as alpha,
 least(greatest({_TEMP('5.8e3')}*least(greatest(1+tr*cd,5.2e-1),1.45e0),2500e0),10000e0) as tt from fl)"""
_GREEN = "(case when tt <= 2500 then 0.25e0" + "".join(f" when tt <= {b[0]} then {a[2]}e0 + (tt - {a[0]}e0) * ({b[2] - a[2]:.17g}e0/{b[0] - a[0]}e0)" for a, b in zip(photometry.VIVID, photometry.VIVID[1:])) + " end)"
_BAL = f"""kb as (select *, {_BUCKET} as bucket, {_ZONE} as zone, {_uniform('source_id', 42)} as hh from k),
z0 as (select *, row_number() over (partition by cls, zone order by hh, source_id) as r from kb where bucket = 'galactic'),
t0 as (select *, zone = 'centre' and r <= 130 as t from z0),
t1 as (select *, row_number() over (partition by cls, t, abs(b) <= 15 order by hh, source_id) as r1 from t0),
t2 as (select *, t or (not t and abs(b) <= 15 and r1 <= 90) as tt from t1),
t3 as (select *, row_number() over (partition by cls, tt, abs(b) > 15, abs(b) > 45 order by hh, source_id) as r2 from t2),
t4 as (select *, tt or (abs(b) > 15 and r2 <= case when abs(b) <= 45 then 50 else 30 end) as t5 from t3),
t6 as (select *, row_number() over (partition by cls, t5 order by hh, source_id) as r3, count(*) filter (where t5) over (partition by cls) as got from t4)"""

ORACLE = {
    "cat_rr_lyrae": _study_sql("vari_rrlyrae", 0.5, "RR_LYRAE", "RR", "best_classification"),
    "cat_cepheids": _study_sql("vari_cepheid", 5.0, "CEPHEIDS", "CEP", "type_best_classification"),
    "cat_lbv": _class_sql("best_class_name = 'BE|GCAS|SDOR|WR'", 100.0, "'LBV'"),
    "cat_cataclysmic": _class_sql("best_class_name = 'CV'", 0.2, "'CATACLYSMIC'"),
    "cat_zz_ceti": _class_sql("best_class_name = 'WD'", 0.01, "'ZZ_CETI'"),
    "cat_other": _class_sql("best_class_name not in ('RR','CEP','BE|GCAS|SDOR|WR','CV','WD')", 1.0, "trim(best_class_name)"),
    "cat_microlensing": ctes("sources", "vari_microlensing", "astrophysical_parameters") + """select v.source_id, round(l,7) as l, round(b,7) as b, round(parallax,7) as parallax, round(paczynski0_tmax,7) as paczynski0_tmax, round(paczynski0_te,7) as paczynski0_te, round(paczynski0_u0,7) as paczynski0_u0, round(azero_gspphot,7) as azero_gspphot, round(abp_gspphot,7) as abp_gspphot, round(arp_gspphot,7) as arp_gspphot
from vari_microlensing v join sources s using (source_id) left join astrophysical_parameters a using (source_id) where paczynski0_te > 0 and paczynski0_tmax is not null and paczynski0_u0 is not null and parallax > 3e-2 and parallax < 21 and l is not null and b is not null""",
    "top_by_random_index": _S + "select source_id, random_index from sources order by random_index, source_id limit 500",
    "index_range": _S + "select source_id, random_index, round(l,9) as l, round(b,9) as b, round(phot_g_mean_mag,9) as phot_g_mean_mag from sources where random_index >= 200000 and random_index < 400000 and l is not null and b is not null and phot_g_mean_mag is not null",
    "region_filter": _S + "select source_id, round(l,9) as l, round(b,9) as b from sources where abs(((l - 3.23e0 + 180) % 360 + 360) % 360 - 180) <= 5.635e1 and b between 5.9e-1 - 2.819e1 and 5.9e-1 + 2.819e1",
    "region_scan": _S + "select source_id, round(l,9) as l, round(b,9) as b from sources where abs(((l - 3.23e0 + 180) % 360 + 360) % 360 - 180) <= 5.635e1 and b between 5.9e-1 - 2.819e1 and 5.9e-1 + 2.819e1",
    "cone_scan": _S + f"select source_id, round(l,9) as l, round(b,9) as b, round(phot_g_mean_mag,9) as phot_g_mean_mag from sources where {_CONE} or b >= 85",
    "cone_membership": _S + f"select {_CONE} as in_cone, {_MEMBER} as member, count(*) as n from sources group by 1, 2",
    "observability": _S + "select case when dec < -38 then 'never' when dec < -28 then 'low' when dec is not null then 'good' end as class, count(*) as n from sources group by 1",
    "frame_transform": _S + f"select source_id, round(degrees(atan2({_XYZ[1]}, {_XYZ[0]})) + case when atan2({_XYZ[1]}, {_XYZ[0]}) < 0 then 360 else 0 end, 6) as gl, round(degrees(asin(least(greatest({_XYZ[2]}, -1e0), 1e0))), 6) as gb from sources",
    "distances": _S + """select source_id, round(1000/p, 6) as distance_pc, round(1000/(p+e), 6) as distance_low_pc, round(case when p > e then 1000/(p-e) end, 6) as distance_high_pc, round(e/p, 6) as parallax_relative_error, round(case when p/e >= 5 then phot_g_mean_mag + 5*log10(p/1000) + 5 end, 6) as abs_g
from (select *, case when parallax > 0 then parallax end as p, case when parallax_error > 0 then parallax_error end as e from sources)""",
    "stable_uniform": _S + f"select source_id, {_uniform('source_id', 42)} as u42, {_uniform('source_id', 57721)} as u57721 from sources",
    "bucket_caps": _C + f", {_CLASSES}, q as (select *, {_BUCKET} as bucket from k), r as (select *, row_number() over (partition by cls, bucket order by {_uniform('source_id', 42)}, source_id) as n from q where bucket is not null) select cls, bucket, source_id from r where n <= 60",
    "sky_balanced_sample": _C + f", {_CLASSES}, {_BAL} select source_id, cls, zone from t6 where t5 or r3 <= 300 - got",
    "magellanic_cap": _C + f", {_CLASSES}, q as (select *, {_BUCKET} as bucket from k), r as (select *, row_number() over (partition by bucket order by {_uniform('source_id', 42)}, source_id) as n from q where bucket is not null) select source_id, cls, bucket from r where bucket <> 'magellanic' or n <= 80",
    "behaviour_params": _P + " select source_id, bc as behaviour_class, model, flux_mode, round(per,7) as used_period, round(am,7) as used_amplitude, round(ph,7) as used_phase, round(ec,7) as event_centre, round(ir,7) as used_irregularity, round(ew,7) as event_width, round(es,7) as event_shape from par",
    "light_curve_frames": _P + f", {_FR} select bc as behaviour_class, frame::int as frame, count(*) as n, round(avg(rf),6) as mean_flux, round(avg(sigma),6) as mean_sigma, round(avg(alpha),6) as mean_alpha, round(avg({_GREEN}),6) as mean_green from fin group by bc, frame",
    "schema_union": ctes("vari_rrlyrae", "vari_cepheid") + "select 'rr' as origin, count(*) as n, count(pf) as n_pf, 0::bigint as n_p1 from vari_rrlyrae union all select 'cep', count(*), 0::bigint, count(p1_o) from vari_cepheid",
    "missing_ids": ctes("sources", "vari_microlensing") + "select source_id from vari_microlensing where source_id not in (select source_id from sources)",
}


def _star_colour_sql() -> str:
    from .maps import _rgb, _vivid

    (r, g, b), t = _rgb("t"), "least(greatest(t, 2500e0), 10000e0)"
    vr, vg, vb = _vivid(t)
    letter = "case when t >= 30000 then 'O' when t >= 10000 then 'B' when t >= 7500 then 'A' when t >= 6000 then 'F' when t >= 5200 then 'G' when t >= 3700 then 'K' else 'M' end"
    return _S + f"select source_id, round(t,10) as kelvin, round({r},10) as r, round({g},10) as g, round({b},10) as b, round({vr},10) as vr, round({vg},10) as vg, round({vb},10) as vb, {letter} as letter from (select source_id, {_TEMP('5.772e3')} as t from sources)"


ORACLE["star_colours"] = _star_colour_sql()


def _selection_sql() -> str:
    """The same from the statements of the single catalogues, which name their sources."""
    parts = []
    for name in ("lbv", "rr_lyrae", "zz_ceti", "other"):
        parts.append(f"select '{name}' as catalogue, variable_class, source_id, random_index from ({ORACLE['cat_' + name]})")
    return f"select catalogue, variable_class, count(*) as n, sum(source_id)::bigint as ids, max(random_index) as last from (select *, row_number() over (partition by catalogue order by random_index, source_id) as i from ({' union all '.join(parts)})) where i <= 400 group by catalogue, variable_class"


ORACLE["cat_selection"] = _selection_sql()
