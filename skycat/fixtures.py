"""Catalogue views derived from the driver tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import dealt

TABLES = ("lineitem", "orders", "events")

VIEWS = {
    "sources": """
with k as (
  select l_orderkey*8 + l_linenumber as source_id, max(l_partkey) as pk, max(l_suppkey) as sk,
         max(l_quantity) as q, max(l_extendedprice) as p, max(l_discount) as d, max(l_tax) as t,
         max(l_returnflag) as rf, max(l_linestatus) as ls
  from lineitem group by l_orderkey*8 + l_linenumber)
select source_id,
  (source_id * 7919) % 1000003 as random_index,
  (source_id * 1.3750776405003785e2) % 3.6e2 as l,
  degrees(asin(((pk * 6.180339887498949e-1) % 1e0) * 2e0 - 1e0)) as b,
  (source_id * 2.2249223594996215e2) % 3.6e2 as ra,
  degrees(asin(((sk * 7.548776662466927e-1) % 1e0) * 2e0 - 1e0)) as `dec`,
  case when pk % 11 = 0 then null when pk % 13 = 0 then -1e-2 else d * d * 1e1 + (sk % 5) * 1e-2 end as parallax,
  case when sk % 9 = 0 then null else 2e-3 + t * 2.5e-1 end as parallax_error,
  6e0 + q / 5e0 + d * 1e1 as phot_g_mean_mag,
  case when sk % 3 = 0 then null else 3e3 + p / 2e0 end as teff_gspphot,
  case when sk % 3 = 0 then null else (3e3 + p / 2e0) * (9.5e-1 - t * 4e0) end as teff_gspphot_lower,
  case when sk % 3 = 0 then null else (3e3 + p / 2e0) * (1.05e0 + t * 4e0) end as teff_gspphot_upper,
  case when pk % 4 = 0 then null else 1e0 + q / 1.2e1 end as logg_gspphot,
  case when pk % 4 = 0 then null else 1e0 + q / 1.2e1 - t * 6e0 end as logg_gspphot_lower,
  case when pk % 4 = 0 then null else 1e0 + q / 1.2e1 + t * 6e0 end as logg_gspphot_upper,
  case when pk % 7 = 0 then null else 5e-1 + (pk % 90) end as radius_gspphot,
  case when sk % 4 = 0 then null else pow(1e1, (pk % 61) / 1e1) end as lum_flame,
  case when sk % 4 = 1 then null else 1e0 + (pk % 50) end as mass_flame,
  case when pk % 6 = 0 then null when pk % 17 = 0 then -1e-1 else d * 2e1 end as ag_gspphot,
  case when pk % 6 = 0 then null else d * 2e1 - t * 8e0 end as ag_gspphot_lower,
  case when pk % 6 = 0 then null else d * 2e1 + t * 8e0 end as ag_gspphot_upper,
  case when pk % 5 = 0 then null when pk % 19 = 0 then -5e-2 else d * 8e0 end as ebpminrp_gspphot,
  case when pk % 10 = 1 then null else d * 8e0 - t * 4e0 end as ebpminrp_gspphot_lower,
  case when pk % 10 = 1 then null else d * 8e0 + t * 4e0 end as ebpminrp_gspphot_upper,
  case when sk % 8 = 0 then null else -5e-1 + t * 3e1 + d end as bp_rp,
  case when pk % 3 = 0 then null else q * 4e0 end as vbroad,
  case when pk % 3 = 1 then null else q * 2e0 end as rv_amplitude_robust,
  case when rf = 'A' then 'B' when rf = 'N' and ls = 'O' then 'O' when rf = 'R' and pk % 50 = 0 then 'WN5'
       when rf = 'R' and pk % 50 = 1 then 'Be' when rf = 'R' then 'unknown' else null end as spectraltype_esphs
from k
""",
    "vari_classifier_result": """
select source_id, case pk when 0 then 'RR' when 1 then 'CEP' when 2 then 'WD' when 3 then 'CV' when 4 then 'ECL'
  when 5 then 'LPV' when 6 then 'YSO' when 7 then 'XYZ' else 'BE|GCAS|SDOR|WR' end as best_class_name, score as best_class_score
from (select l_orderkey*8 + l_linenumber as source_id, max(l_partkey % 11) as pk, max(l_discount) * 1e1 as score
      from lineitem where l_suppkey % 10 <> 7 group by l_orderkey*8 + l_linenumber) c
""",
    "vari_summary": """
select source_id, r as range_mag_g_fov, r * 8e-1 as trimmed_range_mag_g_fov, r * 2.5e-1 as std_dev_mag_g_fov,
  (r - 6e-1) * 4e0 as skewness_mag_g_fov, case when pk % 5 = 0 then null else r * 6e0 end as kurtosis_mag_g_fov
from (select l_orderkey*8 + l_linenumber as source_id, max(l_tax) * 1.6e1 as r, max(l_partkey) as pk
      from lineitem where l_orderkey % 5 <> 0 group by l_orderkey*8 + l_linenumber) v
""",
    "vari_rrlyrae": """
select l_orderkey*8 + l_linenumber as source_id, max(case when l_partkey % 4 = 0 then null else 2e-1 + l_quantity / 1e2 end) as pf,
  max(case when l_partkey % 6 = 0 then null else 1.5e-1 + l_quantity / 1.2e2 end) as p1_o,
  max(case when l_suppkey % 7 = 0 then null else 1.7e3 + l_tax * 1e3 end) as epoch_g,
  max(case when l_partkey % 9 = 0 then -1e0 else l_discount * 1e1 end) as peak_to_peak_g,
  max(case when l_suppkey % 3 = 0 then 'RRab' else '' end) as best_classification
from lineitem where l_orderkey % 9 = 0 group by l_orderkey*8 + l_linenumber
""",
    "vari_microlensing": """
select o_orderkey*8 + 1 as source_id,
  1.7e3 + (o_orderkey * 6.180339887498949e-1 % 1e0) * 1e3 as paczynski0_tmax,
  case when o_orderkey % 23 = 0 then null when o_orderkey % 29 = 0 then 0e0 else 2e0 + o_totalprice / 2.5e3 end as paczynski0_te,
  (o_custkey % 97) / 9.7e1 - 2e-1 as paczynski0_u0,
  case when o_orderkey % 3 = 0 then null else 1.7e3 + (o_orderkey * 6.180339887498949e-1 % 1e0) * 1e3 + 5e-1 end as paczynski1_tmax,
  case when o_orderkey % 3 = 0 then null else 3e0 + o_totalprice / 2.4e3 end as paczynski1_te,
  case when o_orderkey % 3 = 0 then null else (o_custkey % 89) / 8.9e1 end as paczynski1_u0,
  case when o_orderkey % 7 = 0 then -1e-1 else (o_custkey % 120) / 1e2 end as paczynski1_fs_g,
  1.5e1 + (o_custkey % 40) / 1e1 as paczynski1_bp0, 1.45e1 + (o_custkey % 30) / 1e1 as paczynski1_rp0,
  (o_custkey % 11) / 1e1 as paczynski1_fs_bp, (o_custkey % 13) / 1.2e1 as paczynski1_fs_rp
from orders
""",
    "photometry_samples": """
select 'scn' || cast(user_id % 5 as varchar(4)) as series, cast(event_id % 40 as bigint) as sample, event_type as band,
  cast(event_id % 200 as double) * 2.5e0 as t_days, 2e1 - ln(1e0 + value) as mag, value as flux
from events
""",
    "vari_cepheid": """
select l_orderkey*8 + l_linenumber as source_id, max(case when l_partkey % 4 = 0 then null else 1e0 + l_quantity end) as pf,
  max(case when l_partkey % 6 = 0 then null else 8e-1 + l_quantity / 2e0 end) as p1_o,
  max(case when l_suppkey % 7 = 0 then null else 1.7e3 + l_tax * 1e3 end) as epoch_g,
  max(case when l_partkey % 9 = 0 then 0e0 else l_discount * 8e0 end) as peak_to_peak_g,
  max(case when l_suppkey % 3 = 0 then 'DCEP' when l_suppkey % 3 = 1 then 'T2CEP' else '' end) as type_best_classification
from lineitem where l_orderkey % 9 = 1 group by l_orderkey*8 + l_linenumber
""",
    "astrophysical_parameters": """
select l_orderkey*8 + l_linenumber as source_id, max(l_discount) * 2.2e1 as azero_gspphot,
  max(case when l_partkey % 8 = 0 then null else l_discount * 2.4e1 end) as abp_gspphot,
  max(case when l_partkey % 8 = 0 then null else l_discount * 1.5e1 + l_tax * 4e0 end) as arp_gspphot
from lineitem where l_orderkey % 4 <> 0 group by l_orderkey*8 + l_linenumber
""",
}


def view(spark: SparkSession, sf_dir: str, name: str, bounded: bool = False) -> DataFrame:
    """The catalogue view `name` over the tables of `sf_dir`; the optimiser prunes what a query doesn't use.

    `bounded`: the rows of a view over lineitem are dealt by their id, a bounded number to a task (see dealt), before they are grouped.
    """
    for table in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if bounded and table == "lineitem":
            rows = dealt(rows, rows.count(), F.expr("l_orderkey*8 + l_linenumber"))
        rows.createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def ctes(*names: str) -> str:
    """The head of a DuckDB statement that defines the named views."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n].replace('`', chr(34))})" for n in names) + "\n"
