"""Queries on sky grids, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import ctes, view
from ..functions import coords, photometry
from ..operators import coverage, grid
from ..sources import tables
from ..workspace import written

W, H = 64, 32
REGION = coords.Region()


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sources")


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.select(*(F.round(F.col(c), places).alias(c) if c in columns else F.col(c) for c in df.columns))


def sky_histogram(spark, sf_dir):
    stars = written(_sources(spark, sf_dir).select("l", "b", "phot_g_mean_mag", "teff_gspphot", "bp_rp"), "stars")
    cells = grid.mean_temperature(grid.sky_histogram(stars, W, H, grid.flux_ceiling(stars)))
    return _rounded(cells, 9, "flux", "temp_flux").withColumn("mean_temperature", F.round("mean_temperature", 4))


def region_histogram(spark, sf_dir):
    return _rounded(grid.region_histogram(_sources(spark, sf_dir), REGION, 48, 24), 9, "flux", "temp_flux")


def hammer_weighted(spark, sf_dir):
    return _rounded(grid.hammer_histogram(_sources(spark, sf_dir), W, H, "phot_g_mean_mag", "magnitude"), 9, "value")


def flux_ceiling(spark, sf_dir):
    return _rounded(grid.flux_ceiling(_sources(spark, sf_dir)), 9, "bright_mag", "flux_max")


def coverage_counts(spark, sf_dir):
    return grid.coverage(_sources(spark, sf_dir))


def _dense(spark, sf_dir):
    cells = grid.sky_histogram(_sources(spark, sf_dir), W, H)
    # every limit and the last stretch read the whole grid: it is made once
    return written(grid.dense(spark, cells, W, H, ["flux", "temp_flux", "n"]), "grid")


def tone_limits(spark, sf_dir):
    return _rounded(grid.tone_limits(_dense(spark, sf_dir)), 9, "flux_low", "flux_high", "n_low", "n_high")


def tone_mapped_cells(spark, sf_dir):
    cells = _dense(spark, sf_dir)
    return _rounded(grid.tone_map(cells, grid.tone_limits(cells)), 6, "red", "green", "blue")


def psf_convolve(spark, sf_dir):
    kernel = grid.moffat(5, 2.0, 2.8)
    cells = grid.sky_histogram(_sources(spark, sf_dir), W, H)
    return _rounded(grid.convolve(cells, kernel, W, H, ["flux"]), 9, "flux")


def star_psf(spark, sf_dir):
    """The real point spread, 81 pixels wide, on a map of faint and bright stars, by tiles."""
    cells = grid.hammer_histogram(_sources(spark, sf_dir), 256, 128, "phot_g_mean_mag", "count")
    spread = grid.convolve_tiles(cells, grid.star_kernel(), 256, 128, "value", tile=64)
    return spread.groupBy(F.floor(F.col("x") / 16).alias("bx"), F.floor(F.col("y") / 16).alias("by")).agg(F.round(F.sum("value"), 6).alias("value"), F.round(F.max("value"), 6).alias("top"))


def hammer_modes(spark, sf_dir):
    """The same map of each value mode."""
    rows = _sources(spark, sf_dir).withColumn("tenth", F.col("phot_g_mean_mag") / 10.0)
    found = None
    for mode in ("intensity", "log10", "count", "magnitude"):
        one = grid.hammer_histogram(rows, W, H, "tenth", mode).select(F.lit(mode).alias("mode"), "x", "y", F.round("value", 8).alias("value"))
        found = one if found is None else found.unionByName(one)
    return found


def nonzero_cells(spark, sf_dir):
    return grid.nonzero_cells(_dense(spark, sf_dir))


def palettes(spark, sf_dir):
    """Every palette, plain and reversed, over the cells' shares of the greatest value."""
    cells = grid.hammer_histogram(_sources(spark, sf_dir), W, H, "phot_g_mean_mag", "count")
    rows = cells.crossJoin(F.broadcast(cells.agg(F.max("value").alias("top")))).withColumn("u", F.col("value") / F.col("top"))
    found = None
    for kind in ("grey", "two_colours", "blue_white_red"):
        for back in (False, True):
            r, g, b = grid.palette(photometry.stretch(F.col("u"), "sqrt"), kind, (255, 128, 0), back, (0, 0, 64))
            one = rows.groupBy(F.lit(kind).alias("kind"), F.lit(back).alias("back")).agg(F.sum(r).cast("long").alias("red"), F.sum(g).cast("long").alias("green"), F.sum(b).cast("long").alias("blue"))
            found = one if found is None else found.unionByName(one)
    return found


def raster_cells(spark, sf_dir):
    """An equirectangular raster of three channels as a cell table with positions and luminance."""
    cells = grid.sky_histogram(_sources(spark, sf_dir), W, H).select(F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("n").cast("double").alias("red"), (F.col("n") % 7).cast("double").alias("green"), F.lit(1.0).alias("blue"))
    return _rounded(tables.raster_cells(cells, W, H, order="south_to_north"), 9, "l", "b", "value")


def gauss_smooth(spark, sf_dir):
    cells = grid.hammer_histogram(_sources(spark, sf_dir), W, H, "phot_g_mean_mag", "count")
    return _rounded(grid.smooth(cells, 1.2, W, H, "value"), 6, "value")


def hammer_resample(spark, sf_dir):
    cells = grid.sky_histogram(_sources(spark, sf_dir), W, H).select("x", "y", "flux", "n")
    return _rounded(grid.resample(cells, grid.hammer_pixels(spark, W, H), W, H), 9, "flux")


def layer_limits(spark, sf_dir):
    cells = grid.hammer_histogram(_sources(spark, sf_dir), W, H, "phot_g_mean_mag", "magnitude")
    return _rounded(grid.layer_limits(cells, "value", 0.5, 99.7, 1e3, 1.0), 6, "lower", "upper")


def layer_palette(spark, sf_dir):
    cells = grid.hammer_histogram(_sources(spark, sf_dir), W, H, "phot_g_mean_mag", "magnitude")
    limits = grid.layer_limits(cells, "value", 0.5, 99.7)
    rows = cells.crossJoin(F.broadcast(limits)).withColumn("u", photometry.clip((F.col("value") - F.col("lower")) / (F.col("upper") - F.col("lower")), 0.0, 1.0))
    r, g, b = grid.palette(photometry.stretch(F.col("u"), "asinh"), "blue_white_red")
    return rows.select("x", "y", r.alias("red"), g.alias("green"), b.alias("blue"))


def stretches(spark, sf_dir):
    """Every display curve over the cells' shares of the greatest value."""
    cells = grid.hammer_histogram(_sources(spark, sf_dir), W, H, "phot_g_mean_mag", "count")
    rows = cells.crossJoin(F.broadcast(cells.agg(F.max("value").alias("top")))).withColumn("u", F.col("value") / F.col("top"))
    curves = {k: photometry.stretch(F.col("u"), k, 6.0, 0.7) for k in ("linear", "asinh", "log", "sqrt", "power")}
    return rows.select("x", "y", *(F.round(c, 9).alias(k) for k, c in curves.items()))


def healpix_ring_density(spark, sf_dir):
    stars = _sources(spark, sf_dir).filter("l is not null and b is not null")
    return stars.groupBy(coords.healpix_ring(8, F.col("l"), F.col("b")).alias("pix")).agg(F.count("*").alias("n"), F.round(F.avg("phot_g_mean_mag"), 10).alias("mean_g"))


def healpix_nested_density(spark, sf_dir):
    stars = _sources(spark, sf_dir).filter("l is not null and b is not null")
    return stars.groupBy(coords.healpix_nested(8, F.col("l"), F.col("b")).alias("pix")).agg(F.count("*").alias("n"))


def healpix_lookup(spark, sf_dir):
    """Hammer pixels that read a HEALPix map."""
    return coverage.lookup(grid.hammer_pixels(spark, W, H), healpix_ring_density(spark, sf_dir), 8).select("px", "py", "pix", "n")


def bilinear_lookup(spark, sf_dir):
    raster = grid.sky_histogram(_sources(spark, sf_dir), W, H).select(F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("flux").alias("value"))
    pixels = grid.hammer_pixels(spark, W, H)
    points = pixels.select("px", "py", ((F.pmod(180.0 - F.col("l"), F.lit(360.0))) * (W / 360.0) - 0.5).alias("fx"), ((F.col("b") + 90.0) * (H / 180.0) - 0.5).alias("fy"))
    return _rounded(grid.bilinear(points, raster, W, H, ["px", "py"]), 9, "value")


def splat_pixels(spark, sf_dir):
    """Stars as spots on a Hammer image."""
    # the temperature is a column of its own, which every step of the palette reads
    kelvin = photometry.temperature(F.col("teff_gspphot"), F.col("bp_rp"), photometry.VARIABLE_FALLBACK_K)
    stars = view(spark, sf_dir, "sources", bounded=True).select("l", "b", "phot_g_mean_mag", kelvin.alias("kelvin"))
    x, y = coords.hammer_xy(F.col("l"), F.col("b"))
    r, g, b = photometry.vivid_rgb(F.col("kelvin"))
    spots = stars.select((x * 128).alias("x"), (y * 64).alias("y"), (2.0 - F.col("phot_g_mean_mag") / 8.0).alias("sigma"), F.lit(0.05).alias("alpha"), r.alias("red"), g.alias("green"), b.alias("blue"))
    return grid.splat(spots, 128, 64)


QUERIES = {f.__name__: f for f in (star_psf, hammer_modes, nonzero_cells, palettes, raster_cells, sky_histogram, region_histogram, hammer_weighted, flux_ceiling, coverage_counts, tone_limits, tone_mapped_cells, psf_convolve, gauss_smooth, hammer_resample, layer_limits, layer_palette, stretches, healpix_ring_density, healpix_nested_density, healpix_lookup, bilinear_lookup, splat_pixels)}

_S = ctes("sources")
_FLUX = "pow(10e0, -4e-1 * phot_g_mean_mag)"
_TEMP = "coalesce(teff_gspphot, case when bp_rp is not null then 4.6e3 * (1e0/(9.2e-1*least(greatest(bp_rp,-5e-1),4e0)+1.7e0) + 1e0/(9.2e-1*least(greatest(bp_rp,-5e-1),4e0)+6.2e-1)) end, 5.772e3)"
_CELL = f"""least(greatest(cast(floor((-(case when l > 180 then l - 360 else l end) + 180) * ({W}e0/360)) as bigint), 0), {W-1}) as x,
 least(greatest(cast(floor((b + 90) * ({H}e0/180)) as bigint), 0), {H-1}) as y"""
_CELLS = f"""cells as (select x, y, sum(f) as flux, sum(f*t) as temp_flux, count(*) as n from (
 select {_CELL}, {_FLUX} as f, {_TEMP} as t from sources where l is not null and b between -90 and 90 and phot_g_mean_mag is not null) group by x, y)"""
_GRID = f"""grid as (select x, y, coalesce(flux, 0e0) as flux, coalesce(temp_flux, 0e0) as temp_flux, coalesce(n, 0) as n from
 (select i % {W} as x, i // {W} as y from range({W*H}) r(i)) left join cells using (x, y))"""
_LIMITS = "lim as (select quantile_cont(ln(1+flux), 0.001) as flux_low, quantile_cont(ln(1+flux), 0.9999) as flux_high, quantile_cont(ln(1+n), 0.01) as n_low, quantile_cont(ln(1+n), 0.9985) as n_high from grid)"
_LON = "-radians((((l + 180) % 360) + 360) % 360 - 180)"
_HX = f"((cos(radians(b)) * sin({_LON}/2) / sqrt(greatest(1 + cos(radians(b))*cos({_LON}/2), 2.2250738585072014e-308)) + 1) / 2)"
_HY = f"((1 - sin(radians(b)) / sqrt(greatest(1 + cos(radians(b))*cos({_LON}/2), 2.2250738585072014e-308))) / 2)"
_HCELL = f"least(greatest(cast(floor({_HX}*{W}) as bigint),0),{W-1}) as x, least(greatest(cast(floor({_HY}*{H}) as bigint),0),{H-1}) as y"


def _hammer(value: str) -> str:
    return f"ham as (select x, y, sum(w) as value from (select {_HCELL}, {value} as w from sources where l is not null and b between -90 and 90 and phot_g_mean_mag is not null) group by x, y)"


_INVERSE = f"""pixels as (select px, py, ((-degrees(lon)) % 360 + 360) % 360 as l, degrees(asin(greatest(-1e0, least(1e0, z*hy)))) as b from (
 select *, 2*atan2(z*hx, 2*(2*z*z-1)) as lon from (select *, sqrt(greatest(z2, 0e0)) as z from (
 select *, 1 - hx*hx/16 - hy*hy/4 as z2 from (select i % {W} as px, i // {W} as py, ((i % {W} + 0.5e0)/{W}*2 - 1)*(2*sqrt(2e0)) as hx, (1 - (i // {W} + 0.5e0)/{H}*2)*sqrt(2e0) as hy from range({W*H}) r(i)))) where z2 >= 0.5))"""
_TT = "((radians(l) % (2*pi()) + 2*pi()) % (2*pi()) / (pi()/2))"
_Z = "sin(radians(b))"


def _ring(n: int) -> str:
    """RING pixel by the published formulas, in steps."""
    return f"""(case when abs({_Z}) <= 2e0/3 then
 {2*n*(n-1)} + (({n}+1+cast(floor({n}*(0.5+{_TT})-{n}*{_Z}*0.75) as bigint)-cast(floor({n}*(0.5+{_TT})+{n}*{_Z}*0.75) as bigint)) - 1)*{4*n}
 + (((cast(floor((cast(floor({n}*(0.5+{_TT})-{n}*{_Z}*0.75) as bigint) + cast(floor({n}*(0.5+{_TT})+{n}*{_Z}*0.75) as bigint) - {n}
   + (1 - (({n}+1+cast(floor({n}*(0.5+{_TT})-{n}*{_Z}*0.75) as bigint)-cast(floor({n}*(0.5+{_TT})+{n}*{_Z}*0.75) as bigint)) & 1)) + 1) / 2e0) as bigint)) % {4*n} + {4*n}) % {4*n})
 when {_Z} >= 0 then 2*r*(r-1) + (cast(floor({_TT}*r) as bigint) % (4*r)) else {12*n*n} - 2*r*(r+1) + (cast(floor({_TT}*r) as bigint) % (4*r)) end)"""


def _with_ring(n: int, src: str) -> str:
    return f"(select *, cast(floor(({_TT}-floor({_TT}))*{n}*sqrt(3*(1-abs({_Z})))) + floor((1-({_TT}-floor({_TT})))*{n}*sqrt(3*(1-abs({_Z})))) as bigint) + 1 as r from {src})"


_DENSITY = f"dens as (select {_ring(8)} as pix, count(*) as n, round(avg(phot_g_mean_mag), 10) as mean_g from {_with_ring(8, 'sources')} where l is not null and b is not null group by 1)"
_KERNEL = "ker as (select dx, dy, pow(1+(dx*dx+dy*dy)/4e0, -2.8e0) / sum(pow(1+(dx*dx+dy*dy)/4e0, -2.8e0)) over () as w from range(-2,3) a(dx), range(-2,3) b(dy))"
_LINE = "lin as (select d, exp(-0.5e0*d*d/1.44e0) / sum(exp(-0.5e0*d*d/1.44e0)) over () as w from range(-5,6) a(d))"


def _rgb(t: str) -> tuple[str, str, str]:
    s = f"(least(greatest({t},1e3),4e4)/100)"
    red = f"least(1e0,greatest(0e0,case when {s}<=66 then 1e0 else 1.292936186062745e0*pow(greatest({s}-60,1e-9),-1.332047592e-1) end))"
    green = f"least(1e0,greatest(0e0,case when {s}<=66 then 3.900815787690196e-1*ln({s})-6.318414437886275e-1 else 1.129890860895294e0*pow(greatest({s}-60,1e-9),-7.55148492e-2) end))"
    blue = f"least(1e0,greatest(0e0,case when {s}>=66 then 1e0 when {s}<=19 then 0e0 else 5.432067891101961e-1*ln(greatest({s}-10,1e-9))-1.19625408914e0 end))"
    return red, green, blue


_R, _G, _B = _rgb("least(greatest(temp_flux/greatest(flux,1e-8),2.5e3),2.5e4)")
_SCALE = lambda v, lo, hi: f"(case when {hi}>{lo} then least(greatest((ln(1+{v})-{lo})/({hi}-{lo}),0e0),1e0) else 0e0 end)"


def _vivid(t: str) -> list[str]:
    out = []
    for k in (1, 2, 3):
        parts = "".join(f" when {t} <= {b[0]} then {a[k]}e0 + ({t} - {a[0]}e0) * ({b[k] - a[k]:.17g}e0 / {b[0] - a[0]}e0)" for a, b in zip(photometry.VIVID, photometry.VIVID[1:]))
        out.append(f"(case when {t} <= 2500 then {photometry.VIVID[0][k]}e0{parts} end)")
    return out


_VT = "least(greatest(coalesce(teff_gspphot, case when bp_rp is not null then 4.6e3 * (1e0/(9.2e-1*least(greatest(bp_rp,-5e-1),4e0)+1.7e0) + 1e0/(9.2e-1*least(greatest(bp_rp,-5e-1),4e0)+6.2e-1)) end, 5.8e3), 2500e0), 10000e0)"
_VR, _VG, _VB = _vivid("t")
_U = "least(greatest((value-lower)/(upper-lower),0e0),1e0)"
_I = f"cast(floor(least(greatest(asinh(8e0*{_U})/asinh(8e0),0e0),1e0)*255+0.5) as bigint)"
_LAYER = "lim as (select case when q > p then p else mn end as lower, case when q > p then q when mx > mn then mx else mn+1 end as upper from (select quantile_cont(v, 0.005) as p, quantile_cont(v, 0.997) as q, min(v) as mn, max(v) as mx from (select value*{s}+{o} as v from ham where value <> 0)))"
_UP, _DOWN = f"cast(floor(8*(0.5+{_TT})-8*{_Z}*0.75) as bigint)", f"cast(floor(8*(0.5+{_TT})+8*{_Z}*0.75) as bigint)"
_SPREAD = lambda c: "(" + " + ".join(f"(({c} >> {i}) & 1) * {4**i}" for i in range(3)) + ")"

def _kernel_sql() -> str:
    """The point spread of a star by sums over pixels: two Moffat profiles, blurred along each axis inside the square."""
    span = "range(-40, 41)"
    return f"""ga as (select d, exp(-5e-1*d*d/6.4e-1) as w from range(-3, 4) r(d)), gn as (select d, w/(select sum(w) from ga) as w from ga),
m0 as (select i, j, pow(1 + (i*i+j*j)/3.6e1, -2.8e0) as wide, case when abs(i) <= 15 and abs(j) <= 15 then pow(1 + (i*i+j*j)/4e0, -2.8e0) else 0e0 end as thin from {span} a(i), {span} c(j)),
m1 as (select i, j, 2e-1*wide/(select sum(wide) from m0) + 8e-1*thin/(select sum(thin) from m0) as w from m0),
m2 as (select i + d as i, j, sum(m1.w*gn.w) as w from m1, gn where abs(i + d) <= 40 group by 1, 2),
m3 as (select i, j + d as j, sum(m2.w*gn.w) as w from m2, gn where abs(j + d) <= 40 group by 1, 2), ker as (select i, j, w/(select sum(w) from m3) as w from m3)"""


def _modes_sql() -> str:
    v = {"intensity": "v", "log10": "pow(1e1, v)", "count": "1e0", "magnitude": "pow(1e1, -4e-1*v)"}
    return " union all ".join(f"select '{m}' as mode, x, y, round(sum({e}), 8) as value from hm where v is not null group by x, y" for m, e in v.items())


def _palettes_sql() -> str:
    out = []
    for kind, r, g, b in (("grey", "i", "i", "i"), ("two_colours", "floor(255*i/255e0+5e-1)", "floor(128*i/255e0+5e-1)", "floor(64+(-64)*i/255e0+5e-1)"), ("blue_white_red", "least(255,2*i)", "least(least(255,2*i),least(255,2*(255-i)))", "least(255,2*(255-i))")):
        for back in (False, True):
            i = "(255 - q)" if back else "q"
            sums = ", ".join(f"sum({e})::bigint as {n}" for n, e in (("red", r), ("green", g), ("blue", b)))
            out.append(f"select '{kind}' as kind, {back} as back, {sums} from (select {i} as i from qs)")
    return " union all ".join(out)


_BIG = f"big as (select least(greatest(cast(floor({_HX}*256) as bigint), 0), 255) as x, least(greatest(cast(floor({_HY}*128) as bigint), 0), 127) as y, count(*)::double as v from sources where l is not null and b is not null and phot_g_mean_mag is not null group by 1, 2)"

ORACLE = {
    "star_psf": _S + f""", {_BIG}, {_kernel_sql()}, sp as (select x + i as x, y + j as y, sum(v*w) as v from big, ker where x + i between 0 and 255 and y + j between 0 and 127 group by 1, 2)
select x // 16 as bx, y // 16 as "by", round(sum(v), 6) as value, round(max(v), 6) as top from sp group by 1, 2""",
    "hammer_modes": _S + f", hm as (select least(greatest(cast(floor({_HX}*{W}) as bigint), 0), {W-1}) as x, least(greatest(cast(floor({_HY}*{H}) as bigint), 0), {H-1}) as y, phot_g_mean_mag/1e1 as v from sources where l is not null and b is not null) " + _modes_sql(),
    "nonzero_cells": _S + f", {_CELLS} select count(*) filter (where flux <> 0) as nonzero from cells",
    "palettes": _S + f", {_hammer('1e0')}, qs as (select floor(least(greatest(sqrt(value/(select max(value) from ham)),0e0),1e0)*255+5e-1) as q from ham) " + _palettes_sql(),
    "raster_cells": _S + f", {_CELLS} select x as ix, y as iy, round((-180 + (x + 5e-1)*(360e0/{W}) + 360) % 360, 9) as l, round((y + 5e-1)*(180e0/{H}) - 90, 9) as b, round(2.126e-1*n + 7.152e-1*(n % 7) + 7.22e-2, 9) as value from cells",
    "sky_histogram": _S + f""", top as (select pow(10e0, -4e-1*quantile_cont(phot_g_mean_mag, 0.001)) as m from sources)
select x, y, round(sum(f), 9) as flux, round(sum(f*t), 9) as temp_flux, count(*) as n, round(least(greatest(sum(f*t)/greatest(sum(f), 1e-8), 2.5e3), 2.5e4), 4) as mean_temperature from (
 select {_CELL}, least({_FLUX}, m) as f, {_TEMP} as t from sources, top where l is not null and b between -90 and 90 and phot_g_mean_mag is not null) group by x, y""",
    "region_histogram": _S + f"""select x, y, round(sum(f), 9) as flux, round(sum(f*t), 9) as temp_flux, count(*) as n from (
 select least(greatest(cast(floor((5.635e1 - dl)*(48/1.127e2)) as bigint), 0), 47) as x, least(greatest(cast(floor((5.9e-1 + 2.819e1 - b)*(24/5.638e1)) as bigint), 0), 23) as y, f, t from (
  select b, ((l - 3.23e0 + 180) % 360 + 360) % 360 - 180 as dl, {_FLUX} as f, {_TEMP} as t from sources where phot_g_mean_mag is not null)
 where abs(dl) <= 5.635e1 and b between 5.9e-1 - 2.819e1 and 5.9e-1 + 2.819e1) group by x, y""",
    "hammer_weighted": _S + f", {_hammer(_FLUX)} select x, y, round(value, 9) as value from ham",
    "flux_ceiling": _S + "select round(m, 9) as bright_mag, round(pow(10e0, -4e-1*m), 9) as flux_max from (select quantile_cont(phot_g_mean_mag, 0.001) as m from sources)",
    "coverage_counts": _S + "select count(*) as valid, count(teff_gspphot) as with_teff, count(bp_rp) as with_colour, count(*) filter (where teff_gspphot is null and bp_rp is null) as with_neither from sources where l is not null and b between -90 and 90 and phot_g_mean_mag is not null",
    "tone_limits": _S + f", {_CELLS}, {_GRID}, {_LIMITS} select round(flux_low,9) as flux_low, round(flux_high,9) as flux_high, round(n_low,9) as n_low, round(n_high,9) as n_high from lim",
    "tone_mapped_cells": _S + f""", {_CELLS}, {_GRID}, {_LIMITS},
k as (select x, y, {_R} as r, {_G} as g, {_B} as b, pow(asinh(2.5e0*{_SCALE('flux','flux_low','flux_high')})/asinh(2.5e0), 1.5e0) * (8.5e-1 + 1.5e-1*pow(asinh(4.5e0*{_SCALE('n','n_low','n_high')})/asinh(4.5e0), 9.5e-1)) as s from grid, lim),
m as (select x, y, r*s as r, g*s as g, b*s as b, (r*s+g*s+b*s)/3 as q from k),
v as (select x, y, least(greatest(q+3.5e0*(r-q),0e0),1e0) as r, least(greatest(q+3.5e0*(g-q),0e0),1e0) as g, least(greatest(q+3.5e0*(b-q),0e0),1e0) as b from m),
t as (select max(greatest(r,g,b)) as top from v)
select x, y, round(pow(least(greatest(r/top,0e0),1e0),4.5e-1),6) as red, round(pow(least(greatest(g/top,0e0),1e0),4.5e-1),6) as green, round(pow(least(greatest(b/top,0e0),1e0),4.5e-1),6) as blue from v, t""",
    "psf_convolve": _S + f", {_CELLS}, {_KERNEL} select x+dx as x, y+dy as y, round(sum(flux*w), 9) as flux from cells, ker where x+dx between 0 and {W-1} and y+dy between 0 and {H-1} group by x+dx, y+dy",
    "gauss_smooth": _S + f", {_hammer('1e0')}, {_LINE}, a as (select x+d as x, y, sum(value*w) as value from ham, lin where x+d between 0 and {W-1} group by x+d, y) select x, y+d as y, round(sum(value*w), 6) as value from a, lin where y+d between 0 and {H-1} group by x, y+d",
    "hammer_resample": _S + f""", {_CELLS}, {_INVERSE},
p as (select px, py, least(greatest(cast(floor((-radians(case when l > 180 then l-360 else l end)+pi())*({W}/(2*pi()))) as bigint),0),{W-1}) as x, least(greatest(cast(floor((radians(b)+pi()/2)*({H}/pi())) as bigint),0),{H-1}) as y from pixels)
select px, py, round(flux, 9) as flux, n from p left join cells using (x, y)""",
    "layer_limits": _S + f", {_hammer(_FLUX)}, {_LAYER.format(s='1e3', o='1e0')} select round(lower, 6) as lower, round(upper, 6) as upper from lim",
    "layer_palette": _S + f", {_hammer(_FLUX)}, {_LAYER.format(s='1e0', o='0e0')} select x, y, cast(least(255, 2*{_I}) as int) as red, cast(least(255, 2*{_I}, 2*(255-{_I})) as int) as green, cast(least(255, 2*(255-{_I})) as int) as blue from ham, lim",
    "stretches": _S + f", {_hammer('1e0')}, q as (select x, y, value/(select max(value) from ham) as u from ham) select x, y, round(u,9) as linear, round(asinh(6*u)/asinh(6e0),9) as asinh, round(ln(1+6*u)/ln(7e0),9) as log, round(sqrt(u),9) as sqrt, round(pow(u,7e-1),9) as power from q",
    "healpix_ring_density": _S + f", {_DENSITY} select * from dens",
    "healpix_nested_density": _S + f""", q as (select *, {_TT} as t, {_Z} as z, {_UP} as up, {_DOWN} as dn, 8*sqrt(3*(1-abs({_Z}))) as rad, cast(least(floor({_TT}), 3) as bigint) as qu from sources where l is not null and b is not null),
f as (select *, cast(least(floor((t-qu)*rad), 7) as bigint) as pa, cast(least(floor((1-(t-qu))*rad), 7) as bigint) as pd from q),
g as (select case when abs(z) <= 2e0/3 then case when up//8 = dn//8 then (up//8) | 4 when up//8 < dn//8 then up//8 else dn//8 + 8 end when z >= 0 then qu else qu + 8 end as face,
 case when abs(z) <= 2e0/3 then dn % 8 when z >= 0 then 7 - pd else pa end as xi, case when abs(z) <= 2e0/3 then 7 - up % 8 when z >= 0 then 7 - pa else pd end as yi from f)
select face*64 + {_SPREAD('xi')} + 2*{_SPREAD('yi')} as pix, count(*) as n from g group by 1""",
    "healpix_lookup": _S + f", {_DENSITY}, {_INVERSE}, q as (select px, py, {_ring(8)} as pix from {_with_ring(8, 'pixels')}) select px, py, pix, n from q left join dens using (pix)",
    "bilinear_lookup": _S + f""", {_CELLS}, {_INVERSE},
p as (select px, py, ((180 - l) % 360 + 360) % 360 * ({W}/360e0) - 0.5e0 as fx, (b+90)*({H}/180e0) - 0.5e0 as fy from pixels),
c as (select px, py, (cast(floor(fx) as bigint) + dx + {W}) % {W} as x, least(greatest(cast(floor(fy) as bigint) + dy, 0), {H-1}) as y,
 (case when dx = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) * (case when dy = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end) as w from p, range(2) a(dx), range(2) b(dy))
select px, py, case when count(flux) = 4 then round(sum(w*flux), 9) end as value from c left join cells using (x, y) group by px, py""",
    "splat_pixels": _S + f""", s as (select {_HX}*128 as x, {_HY}*64 as y, greatest(2e0 - phot_g_mean_mag/8e0, 1e0) as s, {_VT} as t from sources where l is not null and b is not null),
c as (select *, (trunc(x) - floor(3.5e0*s) - 1)::int as x0, (trunc(x) + floor(3.5e0*s) + 1)::int as x1, (trunc(y) - floor(3.5e0*s) - 1)::int as y0, (trunc(y) + floor(3.5e0*s) + 1)::int as y1 from s),
d as (select *, unnest(range(greatest(x0, 0), least(x1, 127) + 1)) as px from c), e as (select *, unnest(range(greatest(y0, 0), least(y1, 63) + 1)) as py from d),
p as (select px, py, least(exp(-((px-x)*(px-x)+(py-y)*(py-y))/(2*s*s))*2, 1e0)*5e-2 as k, {_VR} as r, {_VG} as g, {_VB} as b from e)
select px, py, cast(least(255, sum(floor(least(k*r*255,255e0)))) as int) as red, cast(least(255, sum(floor(least(k*g*255,255e0)))) as int) as green, cast(least(255, sum(floor(least(k*b*255,255e0)))) as int) as blue
from p group by px, py having sum(floor(least(k*r*255,255e0))) + sum(floor(least(k*g*255,255e0))) + sum(floor(least(k*b*255,255e0))) > 0""",
}
