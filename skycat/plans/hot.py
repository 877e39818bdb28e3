"""Queries on hot variable stars, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ctes, view
from ..operators import behaviour, classify
from ..workspace import fresh_dir, written


def _candidates(spark, sf_dir):
    stars = view(spark, sf_dir, "sources").join(view(spark, sf_dir, "vari_classifier_result").filter("best_class_name = 'BE|GCAS|SDOR|WR'"), "source_id")
    return stars.join(view(spark, sf_dir, "vari_summary"), "source_id", "left")


def reddening_quality(spark, sf_dir):
    rows = classify.reddening(_candidates(spark, sf_dir))
    return rows.select("source_id", "reddening_quality", (F.round("bp_rp_intrinsic", 9) + 0.0).alias("bp_rp_intrinsic"), F.concat_ws(";", "extinction_flags").alias("flags"))


def hot_scores(spark, sf_dir):
    rows = classify.scores(classify.reddening(_candidates(spark, sf_dir)))
    return rows.select("source_id", *(F.round(f"score_{c}", 8).alias(f"score_{c}") for c in ("be", "gcas", "sdor", "wr")), F.col("n_features").cast("long").alias("n_features"), F.col("groups_sdor").cast("long").alias("groups_sdor"), F.col("groups_wr").cast("long").alias("groups_wr"), F.round("variability", 6).alias("variability"))


def hot_classify(spark, sf_dir):
    rows = classify.classify(_candidates(spark, sf_dir))
    return rows.select("source_id", "resolved_class", F.round("classification_score", 10).alias("classification_score"), F.round("classification_margin", 8).alias("classification_margin"), "classification_method")


def class_report(spark, sf_dir):
    rows = classify.report(classify.classify(_candidates(spark, sf_dir)))
    return rows.select("resolved_class", "n", *(F.round(f"median_{c}", 6).alias(f"median_{c}") for c in classify.REPORTED))


def class_counts(spark, sf_dir):
    return classify.report_counts(classify.classify(_candidates(spark, sf_dir)))


#: Texts that name classes in several ways, or none.
LABELS = ("WN5", "Wolf Rayet", "LBV", "S Dor", "gamma Cas", "B[e]", "Be", "--", "", "unknown", "WC7", "star of Be2 type", "lbv candidate", "B [ e ]", "OB", "nan", "gamma  cassiopeiae", "Emission-line B")


def hot_labels(spark, sf_dir):
    """Literature and spectral texts dealt to the candidates by their ids, and what the classifier makes of them."""
    pick = lambda step: F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod(F.floor(F.col("source_id") / step), F.lit(len(LABELS))) + 1).cast("int"))
    rows = _candidates(spark, sf_dir).withColumns({"spectraltype_esphs": pick(1), "literature_class": F.when(F.col("source_id") % 2 == 0, pick(2))})
    # written before and after: a filter pushed into the rules, or the choice repeated in each, would be a plan of thousands of terms
    rows = classify.classify(written(rows, "labels")).select("source_id", "resolved_class", "classification_method", F.round("classification_score", 9).alias("classification_score"))
    return written(rows, "labelled").filter("classification_method in ('literature_label', 'spectral_type')")


def insufficient_data(spark, sf_dir):
    """Candidates without any measurement but their magnitude: none can be told."""
    rows = _candidates(spark, sf_dir).select("source_id", "phot_g_mean_mag", "best_class_score")
    rows = classify.classify(rows)
    return rows.groupBy("resolved_class", "classification_method").agg(F.count("*").alias("n"))


def written_by_class(spark, sf_dir):
    """A folder for each class, read back by class and as a whole."""
    rows = classify.classify(_candidates(spark, sf_dir)).select("source_id", "resolved_class", "phot_g_mean_mag")
    classify.write_by_class(rows, path := fresh_dir(spark, "classes"))
    back = spark.read.schema("source_id long, phot_g_mean_mag double, resolved_class string").parquet(path)
    return back.groupBy("resolved_class").agg(F.count("*").alias("n"), F.sum("source_id").alias("ids"), F.round(F.sum("phot_g_mean_mag"), 6).alias("sum_g"))


def dq_invariants(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return classify.invariants(rows, classify.classify(rows))


def colour_inputs(spark, sf_dir):
    rows = behaviour.with_colour_inputs(classify.classify(_candidates(spark, sf_dir)))
    return rows.groupBy("resolved_class", "colour_source").agg(F.count("*").alias("n"), F.round(F.sum("used_teff"), 3).alias("sum_teff"))


def physical_scaling(spark, sf_dir):
    rows = classify.classify(_candidates(spark, sf_dir)).withColumns({"intensity_scale": F.lit(1.2), "size_scale": F.lit(1.1)})
    rows = behaviour.with_physical_scaling(rows)
    return rows.select("source_id", F.round(F.col("intensity_scale") + 1e-10, 8).alias("intensity_scale"), F.round(F.col("size_scale") + 1e-10, 8).alias("size_scale"))


QUERIES = {f.__name__: f for f in (class_counts, hot_labels, insufficient_data, written_by_class, reddening_quality, hot_scores, hot_classify, class_report, dq_invariants, colour_inputs, physical_scaling)}

_AW, _EW = "(ag_gspphot_upper - ag_gspphot_lower)/2", "(ebpminrp_gspphot_upper - ebpminrp_gspphot_lower)/2"
_E, _A = "ebpminrp_gspphot", "ag_gspphot"


def _w(name: str, good: float = 0.25, poor: float = 1.0, absolute: bool = False) -> str:
    width = f"({name}_upper - {name}_lower)/2"
    measure = width if absolute else f"{width}/greatest(abs({name}), 1e-12)"
    return f"(case when {name}_upper >= {name}_lower then 1 - 6.5e-1*least(greatest(({measure} - {good})/{poor - good:.2f}, 0e0), 1e0) else 1e0 end)"


# lum_flame, mass_flame and vbroad have no bounds in the fixtures: their weight is 1
_BASE = ctes("sources", "vari_summary", "vari_classifier_result") + f""", cand as (select s.*, c.best_class_score, v.* exclude (source_id) from sources s join vari_classifier_result c using (source_id) left join vari_summary v using (source_id) where best_class_name = 'BE|GCAS|SDOR|WR'),
iv as (select *, case when ebpminrp_gspphot_upper >= ebpminrp_gspphot_lower then {_EW} end as ew, case when ag_gspphot_upper >= ag_gspphot_lower then {_AW} end as aw, coalesce({_E} >= 0, false) as eu from cand),
rd as (select *, eu and coalesce(ew > greatest(1.5e-1, 7.5e-1*{_E}), false) as we, eu and ew is null as oe, eu and {_A} >= 0 and coalesce(aw > greatest(3e-1, 7.5e-1*{_A}), false) as wa from iv),
rq as (select *, case when {_E} is null then 'missing' when {_E} < 0 then 'invalid' when we or oe or coalesce(wa, false) or (eu and coalesce({_A} < 0, false)) then 'uncertain' else 'good' end as rqual,
 case when eu and not we and not coalesce(wa, false) then bp_rp - {_E} end as bri,
 case when {_A} >= 0 and aw <= greatest(3e-1, 7.5e-1*{_A}) then {_A} end as agr from rd),
ft as (select *, upper(trim(spectraltype_esphs)) as sp, {_w('teff_gspphot')} as wt, {_w('logg_gspphot', 0.30, 1.0, True)} as wg, {_w('radius_gspphot').replace('radius_gspphot_upper >= radius_gspphot_lower', 'false').replace('radius_gspphot_upper', '0').replace('radius_gspphot_lower', '0')} as wr,
 coalesce(teff_gspphot_upper >= teff_gspphot_lower and (teff_gspphot_upper - teff_gspphot_lower)/2/teff_gspphot >= 1, false) as tu,
 case when parallax > 0 and parallax_error > 0 and parallax/parallax_error >= 5 then phot_g_mean_mag - 5*log10(100/parallax) - coalesce(agr, 0e0) end as mg, abs(skewness_mag_g_fov) as sk from rq)"""
_T = "not tu and teff_gspphot"
#: (condition, points BE, GCAS, SDOR, WR), in order
_RULES = (
    ("sp = 'B'", "1.5", "1.2", "0.4", "0"), ("sp = 'O'", "0", "0", "0.4", "1.2"),
    (f"{_T} between 10000 and 30000", "2*wt", "1.7*wt", "0", "0"), (f"{_T} between 8000 and 35000", "0", "0", "0.7*wt", "0"),
    (f"{_T} >= 35000", "-0.8*wt", "-0.5*wt", "0", "2*wt"), (f"{_T} >= 50000", "0", "0", "0", "wt"),
    ("logg_gspphot >= 3.2", "0.8*wg", "0.6*wg", "0", "0"), ("logg_gspphot <= 3", "0", "0", "2*wg", "0"), ("logg_gspphot <= 2", "0", "0", "wg", "0"),
    ("lum_flame >= 20 and lum_flame < 10000", "1", "0.8", "0", "0"), ("lum_flame >= 10000", "0", "0", "1.3", "1"), ("lum_flame >= 100000", "0", "0", "2", "1"), ("lum_flame < 20", "0", "0", "-1", "-0.8"),
    ("mg <= -4", "0", "0", "1", "0.7"), ("mg > -4 and mg <= 2", "0.5", "0.4", "0", "0"), ("mg <= -7", "0", "0", "1", "0.5"),
    ("radius_gspphot between 1 and 20", "0.7", "0.6", "0", "1"), ("radius_gspphot >= 25", "0", "0", "2.5", "-1"), ("radius_gspphot >= 50", "0", "0", "1", "0"),
    ("mass_flame >= 3 and mass_flame < 20", "0.7", "0.5", "0", "0"), ("mass_flame >= 10", "0", "0", "0", "1"), ("mass_flame >= 20", "0", "0", "2", "0"), ("mass_flame >= 40", "0", "0", "1", "0"),
    ("rqual = 'good' and bri <= 0.2", "0.8", "0.7", "0.3", "0.5"), ("(rqual <> 'good' or bri is null) and bp_rp <= -0.1", "0.2", "0.2", "0.1", "0.1"),
    ("vbroad >= 50", "1.5", "0.7", "0", "0"), ("vbroad >= 100", "1.2", "0.5", "0", "0.8"), ("rv_amplitude_robust >= 50", "0", "0.5", "0", "0.3"),
    ("trimmed_range_mag_g_fov <= 0.15", "1.5", "0", "0", "0.7"), ("trimmed_range_mag_g_fov > 0.15 and trimmed_range_mag_g_fov < 0.5", "0", "1.5", "0.5", "0"), ("trimmed_range_mag_g_fov >= 0.5", "0", "1.5", "1.5", "0"), ("trimmed_range_mag_g_fov >= 1", "0", "0.5", "1.5", "0"),
    ("std_dev_mag_g_fov <= 0.05", "1", "0", "0", "0.5"), ("std_dev_mag_g_fov > 0.05 and std_dev_mag_g_fov < 0.15", "0", "1", "0", "0"), ("std_dev_mag_g_fov >= 0.15", "0", "1", "1", "0"),
    ("sk >= 1", "0", "1.2", "0", "0"), ("sk >= 2", "0", "0.7", "0", "0"), ("kurtosis_mag_g_fov >= 3", "0", "1.2", "0", "0"), ("kurtosis_mag_g_fov >= 6", "0", "0.7", "0", "0"),
)


def _total(k: int) -> str:
    steps = ", ".join(f"(case when {r[0]} then {r[k]} else 0 end)::double" for r in _RULES if r[k] != "0")
    return f"list_reduce([0e0, {steps}], lambda s, x: greatest(0e0, s + x))"


_COUNT = "(sp is not null and sp <> '')::int + (teff_gspphot is not null and not tu)::int + " + " + ".join(f"({c} is not null)::int" for c in ("logg_gspphot", "lum_flame", "mg", "radius_gspphot", "mass_flame", "vbroad", "rv_amplitude_robust", "trimmed_range_mag_g_fov", "std_dev_mag_g_fov", "sk", "kurtosis_mag_g_fov")) + " + (rqual = 'good' and bri is not null)::int"
_SD = " + ".join(f"coalesce({c}, false)::int" for c in ("logg_gspphot <= 3", "lum_flame >= 10000", "mg <= -4", "radius_gspphot >= 25", "mass_flame >= 20"))
_WR = " + ".join(f"coalesce({c}, false)::int" for c in ("sp = 'O'", "not tu and teff_gspphot >= 35000", "lum_flame >= 10000", "mg <= -4", "radius_gspphot between 1 and 20", "mass_flame >= 10", "vbroad >= 100"))
_VAR = "(case when trimmed_range_mag_g_fov > 0.15 then 1.5 else 0 end + case when trimmed_range_mag_g_fov >= 1 then 0.5 else 0 end + case when std_dev_mag_g_fov > 0.05 then 1 else 0 end + case when sk >= 1 then 1.2 else 0 end + case when sk >= 2 then 0.7 else 0 end + case when kurtosis_mag_g_fov >= 3 then 1.2 else 0 end + case when kurtosis_mag_g_fov >= 6 then 0.7 else 0 end)::double"
_SCORED = _BASE + f", sc as materialized (select *, {_total(1)} as sbe, {_total(2)} as sgc, {_total(3)} as ssd, {_total(4)} as swr, {_COUNT} as nf, {_SD} as gs, {_WR} as gw, {_VAR} as vv from ft)"
_FINAL = _SCORED + """, sx as (select *, case when sp in ('WR') or regexp_full_match(sp, 'W[CNOR][A-Z]*[0-9]*[A-Z]*') then 'WR' when sp in ('LBV') then 'SDOR' when sp = 'BE' then case when vv >= 2 then 'GCAS' else 'BE' end end as sc0 from sc),
bo as (select *, sbe + (coalesce(sc0, '') = 'BE')::int*8 as b1, sgc + (coalesce(sc0, '') = 'GCAS')::int*8 as g1, ssd + (coalesce(sc0, '') = 'SDOR')::int*8 as s1, swr + (coalesce(sc0, '') = 'WR')::int*8 as w1 from sx),
tp as (select *, greatest(b1, g1, s1, w1) as top, list_sort([b1, g1, s1, w1], 'desc')[2] as second, case greatest(b1, g1, s1, w1) when b1 then 'BE' when g1 then 'GCAS' when s1 then 'SDOR' else 'WR' end as win from bo),
cf as (select *, least(greatest((0.65*least(top/9, 1e0) + 0.35*least((top-second)/greatest(top, 1e-12), 1e0)) * coalesce(0.85 + 0.15*least(greatest(best_class_score, 0e0), 1e0), 1e0), 0e0), 1e0) as conf,
 case when teff_gspphot is not null then teff_gspphot between 8000 and 35000 and not tu else coalesce(sp in ('B', 'O'), false) end as hot from tp),
fn as (select *, nf < 3 as few, (win = 'GCAS' and vv < 2) or (win = 'SDOR' and gs < 2) or (win = 'SDOR' and not hot) or (win = 'WR' and gw < 2) or top < 4 or top - second < 1 or conf < 0.48 as weak from cf),
cl as materialized (select *, case when sc0 is not null then sc0 when few or weak then 'UNKNOWN' else win end as cls from fn)"""

_TEXTS = "[" + ", ".join(f"'{t}'" for t in LABELS) + "]"


def _named(c: str) -> str:
    u = f"(case when upper(trim({c})) in ('', '--', 'NAN', 'NONE', 'NULL', 'UNKNOWN') then null else regexp_replace(upper(trim({c})), '[^A-Z0-9]+', '', 'g') end)"
    sets = {n: "(" + ", ".join(f"'{x}'" for x in v) + ")" for n, v in classify.LABELS.items()}
    return f"(case when {u} in {sets['WR']} or regexp_full_match({u}, 'W[CNOR][A-Z]*[0-9]*[A-Z]*') then 'WR' when {u} in {sets['SDOR']} then 'SDOR' when {u} in {sets['GCAS']} then 'GCAS' when {u} in {sets['BE']} then 'BE' end)"


def _free(c: str) -> str:
    known = f"{c} is not null and upper(trim({c})) not in ('', '--', 'NAN', 'NONE', 'NULL', 'UNKNOWN')"
    has = lambda p: f"regexp_matches(lower({c}), '{p}')"
    first, second, third, last = (has(p) for p in (r"\b(lbv|s\s*dor(adus)?)\b", r"\bgamma\s*cas(siopeiae)?\b", r"\bb\s*\[\s*e\s*\]", r"\bbe([0-9]|\b)"))
    return f"(case when {known} then case when {first} then 'SDOR' when {second} then 'GCAS' when {third} then 'BE' when {last} then 'BE' end end)"


ORACLE = {
    "reddening_quality": _BASE + f""" select source_id, rqual as reddening_quality, round(bri, 9) + 0e0 as bp_rp_intrinsic, array_to_string(list_distinct_keep(fl), ';') as flags from (
 select *, list_filter([case when {_E} is null then 'missing_reddening' end, case when {_E} < 0 then 'invalid_reddening' end, case when oe or we then 'uncertain_reddening' end, case when oe then 'missing_reddening_interval' end,
 case when {_A} < 0 then 'invalid_extinction' end, case when eu and (coalesce({_A} < 0, false) or coalesce(wa, false)) then 'uncertain_reddening' end, case when coalesce(wa, false) then 'uncertain_extinction' end,
 case when {_A} >= 0 and aw is null then 'missing_extinction_interval' end, case when (eu and {_E} >= 0.5) or coalesce({_A} >= 1, false) then 'strong_extinction' end, case when bp_rp is null then 'missing_bp_rp' end], lambda x: x is not null) as fl from rq)""",
    "hot_scores": _SCORED + " select source_id, round(sbe, 8) as score_be, round(sgc, 8) as score_gcas, round(ssd, 8) as score_sdor, round(swr, 8) as score_wr, nf::bigint as n_features, gs::bigint as groups_sdor, gw::bigint as groups_wr, round(vv, 6) as variability from sc",
    "hot_classify": _FINAL + " select source_id, cls as resolved_class, round(case when sc0 = 'BE' then 0.9 when sc0 is not null then 0.95 else conf end, 10) as classification_score, round(top - second, 8) as classification_margin, case when sc0 is not null then 'spectral_type' when few then 'insufficient_data' when weak then 'ambiguous' else 'multi_feature_score' end as classification_method from cl",
    "class_report": _FINAL + " select cls as resolved_class, count(*) as n, " + ", ".join(f"round(median({c}), 6) as median_{c}" for c in classify.REPORTED) + " from cl group by cls",
    "class_counts": _FINAL + """, m as (select *, case when sc0 is not null then 'spectral_type' when few then 'insufficient_data' when weak then 'ambiguous' else 'multi_feature_score' end as method from cl)
select 'class' as what, cls as value, count(*) as n from m group by cls union all select 'method', method, count(*) from m group by method union all select 'reddening', rqual, count(*) from m group by rqual""",
    "hot_labels": _SCORED + f""", k as (select source_id, vv, {_TEXTS}[(source_id % {len(LABELS)} + 1)::int] as sp, case when source_id % 2 = 0 then {_TEXTS}[((source_id // 2) % {len(LABELS)} + 1)::int] end as li from sc),
v as (select *, {_named('li')} as lc, coalesce({_named('sp')}, {_free('sp')}) as s0 from k), w as (select *, case when s0 = 'BE' and vv >= 2 then 'GCAS' else s0 end as s1 from v)
select source_id, coalesce(lc, s1) as resolved_class, case when lc is not null then 'literature_label' else 'spectral_type' end as classification_method, case when lc is not null then 1e0 when s1 = 'BE' then 9e-1 else 9.5e-1 end as classification_score from w where lc is not null or s1 is not null""",
    "insufficient_data": ctes("sources", "vari_classifier_result") + "select 'UNKNOWN' as resolved_class, 'insufficient_data' as classification_method, count(*) as n from sources join vari_classifier_result using (source_id) where best_class_name = 'BE|GCAS|SDOR|WR'",
    "written_by_class": _FINAL + " select cls as resolved_class, count(*) as n, sum(source_id)::bigint as ids, round(sum(phot_g_mean_mag), 6) as sum_g from cl group by cls",
    "dq_invariants": _FINAL + " select (select count(*) from cand) as n_in, count(*) as n_out, count(distinct source_id) as n_ids, count(*) filter (where cls not in ('BE','GCAS','SDOR','WR','UNKNOWN')) as n_wrong, (select count(*) from cand) = count(*) and count(*) = count(distinct source_id) as ok from cl",
}
ORACLE["reddening_quality"] = ORACLE["reddening_quality"].replace("list_distinct_keep(fl)", "list_filter(fl, lambda x, i: list_position(fl, x) = i)")

_FLAGS = "(coalesce(rqual in ('uncertain', 'invalid'), false) and (coalesce(oe, false) or coalesce(we, false) or rqual = 'invalid' or (eu and (coalesce(ag_gspphot < 0, false) or coalesce(wa, false)))))"
_COLOUR = f""", cc as (select *, case when teff_gspphot between 1000 and 200000 then teff_gspphot end as te, bri is not null and rqual = 'good' and not {_FLAGS} as rel,
 coalesce(ag_gspphot >= 1, false) or coalesce(ebpminrp_gspphot >= 0.5, false) as strong from cl),
cg as (select *, te is null and not rel and (cls = 'WR' or (cls in ('SDOR', 'LBV') and strong and coalesce(bp_rp > 0.2, false))) as guard from cc),
ch as (select *, case when not guard then case when rel then bri else bp_rp end end as col from cg),
ck as (select *, case when te is null and col is null then case cls when 'BE' then 18000e0 when 'GCAS' then 18000e0 when 'SDOR' then 20000e0 when 'WR' then 40000e0 end end as st from ch)"""
ORACLE["colour_inputs"] = _FINAL + _COLOUR + " select cls as resolved_class, case when te is not null then 'teff' when col is not null and rel then 'intrinsic' when col is not null then 'observed' when st is not null then 'class' else 'default' end as colour_source, count(*) as n, round(sum(coalesce(te, st)), 3) as sum_teff from ck group by 1, 2"
ORACLE["physical_scaling"] = _FINAL + """ select source_id, round(1.2e0 * case when lum_flame > 0 then least(greatest(1 + 0.08*(log10(lum_flame) - 3), 0.88), 1.22) else 1 end * case when mass_flame > 0 then least(greatest(0.98 + 0.04*ln(1 + mass_flame/10), 0.96), 1.1) else 1 end
 * (0.94 + 0.06*least(greatest(case when sc0 = 'BE' then 0.9 when sc0 is not null then 0.95 else conf end, 0), 1)) + 1e-10, 8) as intensity_scale, round(1.1e0 * case when radius_gspphot > 0 then least(greatest(pow(radius_gspphot/5e0, 0.1), 0.85), 1.25) else 1 end + 1e-10, 8) as size_scale from cl"""
