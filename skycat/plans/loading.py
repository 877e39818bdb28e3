"""Queries that write a catalogue in each format and read it again, with the SQL of what has to come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..fixtures import ctes, view
from ..functions import coords
from ..sources import archive, fits, kinds, sinks, tables
from ..streaming import ingest
from ..workspace import fresh_dir, shuffle_tasks, written
from . import maps, stars
from .catalogues import _tidy
from .maps import H, W


#: Files of src_ecsv hold ids that agree without their lowest bits: about half a million rows.
STRETCH_BITS = 20


def _stars(spark, sf_dir):
    return view(spark, sf_dir, "sources").select("source_id", "random_index", "l", "b", "phot_g_mean_mag", "teff_gspphot", "bp_rp")


def src_scan(spark, sf_dir):
    """A catalogue with capital names and a NaN for each missing temperature, scanned by canonical names."""
    rows = _stars(spark, sf_dir).withColumn("teff_gspphot", F.coalesce("teff_gspphot", F.lit(float("nan"))))
    rows.toDF(*(c.upper() for c in rows.columns)).write.parquet(path := fresh_dir(spark, "scan"))
    return _tidy(tables.scan(spark, path, ["source_id", "l", "teff_gspphot", "absent"], ["source_id", "L"]))


def src_delimited(spark, sf_dir):
    """A TSV file whose values are texts; a row with a text that is no number loses all three."""
    bad = F.when(F.col("source_id") % 10 == 0, "n/a").otherwise(F.col("b").cast("string"))
    rows = _stars(spark, sf_dir).select(F.col("l").alias("GLON"), bad.alias("GLAT"), F.col("phot_g_mean_mag").alias("Mag"))
    rows.write.option("header", True).option("sep", "\t").csv(path := fresh_dir(spark, "tsv"))
    back = tables.read_delimited(spark, path, ("l", "glon"), ("b", "glat"), ("mag",), sep="\t")
    return back.agg(F.count("*").alias("n"), F.count("value").alias("known"), F.round(F.sum("longitude"), 5).alias("sum_l"), F.round(F.sum("latitude"), 5).alias("sum_b"), F.round(F.sum("value"), 5).alias("sum_v"))


def src_ecsv(spark, sf_dir):
    """Files with a commented header above the names, whose types the columns have."""
    text = F.concat_ws(",", "source_id", F.round("l", 6).cast("string"), F.when(F.col("source_id") % 4 != 0, F.col("random_index").cast("string")).otherwise(""), F.when(F.col("source_id") % 2 == 0, "True").otherwise("False"))
    # a file for each stretch of ids: no task's sort grows with the catalogue, only the number of files does
    parts = _stars(spark, sf_dir).select(text.alias("value"), F.shiftright("source_id", STRETCH_BITS).cast("int").alias("part"))
    numbers = [r.part for r in parts.select("part").distinct().collect()] or [0]
    lines = ("# %ECSV 1.0", "# ---", "# delimiter: ','", "# datatype:", "# - {name: source_id, datatype: int64}", "# - {name: l, unit: deg, datatype: float64, description: 'longitude, galactic'}", "# - {name: random_index,", "#    datatype: int32}", "# - {name: even, datatype: bool}", "source_id,l,random_index,even")
    head = spark.createDataFrame([(n,) for n in numbers], "part int").select(F.posexplode(F.array(*map(F.lit, lines))).alias("o", "value"), "part")
    both = head.unionByName(parts.withColumn("o", F.lit(len(lines))))
    both.repartition(len(numbers), "part").sortWithinPartitions("part", "o").select("part", "value").write.partitionBy("part").text(path := fresh_dir(spark, "ecsv"))
    return tables.read_ecsv(spark, f"{path}/part=*")


def src_kinds(spark, sf_dir):
    """The same catalogue in five formats, each known by its content and read by one reader."""
    rows = _stars(spark, sf_dir).select("source_id", F.round("l", 6).alias("l"), F.round("phot_g_mean_mag", 6).alias("g"))
    found = None
    for form in ("parquet", "fits", "csv", "tsv", "json"):
        path = fresh_dir(spark, "kind")
        if form == "fits":
            fits.save(rows, path)
        else:
            out = rows.write.format("csv" if form == "tsv" else form)
            (out.option("header", True).option("sep", "\t" if form == "tsv" else ",") if form in ("csv", "tsv") else out).save(path)
        kind, known = kinds.detect(spark, path)
        back = kinds.read_catalogue(spark, path).select(*(F.col(c).cast(t).alias(c) for c, t in rows.dtypes))
        one = back.agg(F.lit(kind).alias("kind"), F.lit(known).alias("format"), F.count("*").alias("n"), F.sum("source_id").alias("ids"), F.round(F.sum("l"), 3).alias("sum_l"), F.round(F.sum("g"), 3).alias("sum_g"))
        found = one if found is None else found.unionByName(one)
    return found


def src_healpix(spark, sf_dir):
    """Density per pixel as an implicit table of four values a row and as an explicit one, with sentinels and strays."""
    dense = spark.range(768).select(F.col("id").alias("pix"))
    n = _stars(spark, sf_dir).groupBy(coords.healpix_ring(8, F.col("l"), F.col("b")).alias("pix")).agg(F.count("*").alias("n"))
    # 768 rows that both tables are made of: unwritten, each would read the whole catalogue
    rows = written(dense.join(n, "pix", "left").withColumn("v", F.coalesce(F.col("n").cast("double"), F.lit(tables.BAD_DATA))), "density")
    packed = rows.groupBy(F.floor(F.col("pix") / 4).alias("p")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pix", "v"))), lambda x: x.v).alias("v"))
    one = tables.healpix_values(packed, "v", position="p", width=4, nside=8)
    strays = rows.select("pix", "v").unionByName(spark.createDataFrame([(-1, 1.0), (768, 2.0)], "pix long, v double"))
    two = tables.healpix_values(strays, "v", pixel="pix", nside=tables.nside_of(768))
    return one.join(two.withColumnRenamed("value", "value2"), "pix").filter(F.col("value").eqNullSafe(F.col("value2"))).select("pix", "value")


def src_star_list(spark, sf_dir):
    """A user's star list without temperatures and with some magnitudes missing."""
    rows = _stars(spark, sf_dir).select(F.col("l").alias("GLON"), F.col("b").alias("Latitude"), F.when(F.col("source_id") % 3 != 0, F.col("phot_g_mean_mag")).alias("mag"))
    back = tables.star_list(rows.withColumnRenamed("Latitude", "glat"))
    return back.agg(F.count("*").alias("n"), F.round(F.sum("magnitude"), 6).alias("sum_mag"), F.round(F.avg("temperature_k"), 3).alias("mean_t"), F.round(F.sum("b"), 6).alias("sum_b"))


def src_ranges(spark, sf_dir):
    """Ranges of the random index: those already there are left out, each gives at most 500 rows."""
    rows = written(_stars(spark, sf_dir).select("source_id", "random_index"), "ranges")
    bounds = tables.ranges(1_000_003, 12)
    done = rows.filter((F.col("random_index") < bounds[2][0]) & (F.col("random_index") >= bounds[1][0])).select(F.lit(1).alias("range_id"))
    return tables.pull_missing(rows, bounds, done, "random_index", 500).groupBy("range_id").agg(F.count("*").alias("n"), F.max("random_index").alias("last"))


def flaky_archive(path: str):
    """A database connection to the Parquet files of a folder, called in a task; for range 5 it fails the first time."""
    import os

    import duckdb

    class Archive:
        def __init__(self):
            # a task's own share of its executor: by itself DuckDB takes all cores and most of the machine's memory
            self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": False})
            self.db.execute(f"create view stars as select * from '{path}/*.parquet'")

        def cursor(self):
            return self

        def execute(self, sql, values):
            if values[0] == 5 * 83_333 and not os.path.exists(f"{path}.failed"):
                open(f"{path}.failed", "w").close()
                raise ConnectionError("the archive went away")
            self.db.execute(sql, list(values))

        def fetchmany(self, n):
            return self.db.fetchmany(n)

        def close(self):
            self.db.close()

    return Archive()


def src_pull(spark, sf_dir):
    """A pull of twelve ranges, at most 500 rows each, that is broken off once and goes on with what is missing."""
    rows, path = _stars(spark, sf_dir).select("source_id", "random_index", "phot_g_mean_mag"), fresh_dir(spark, "archive")
    rows.write.parquet(path)
    schema, target = "source_id long, random_index long, phot_g_mean_mag double", fresh_dir(spark, "pulled")
    place = "/" + path.removeprefix("file:").lstrip("/")
    archive.pull_or_keep(spark, target, schema, place, "stars", "random_index", 1_000_003, 12, 500, f"{__name__}:flaky_archive")
    return archive.pulled(spark, target, schema).groupBy("range_id").agg(F.count("*").alias("n"), F.min("random_index").alias("first"), F.max("random_index").alias("last"), F.countDistinct("source_id").alias("ids"))


def src_fits(spark, sf_dir):
    """FITS tables written by tasks and read back by ranges, with filters that the reader applies to packed rows."""
    rows = _stars(spark, sf_dir).withColumn("name", F.concat(F.lit("star "), F.col("source_id").cast("string"))).withColumn("index", F.when(F.col("source_id") % 7 != 0, F.col("random_index").cast("int")))
    fits.save(rows.drop("random_index"), path := fresh_dir(spark, "fits"), 20_000)
    key, old = "spark.sql.python.filterPushdown.enabled", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set(key, "true")
    try:
        back = fits.load(spark, path, ["source_id", "index", "l", "teff_gspphot", "phot_g_mean_mag", "name"], 7_000)
        back = written(back.filter("phot_g_mean_mag < 12.5 and index >= 100000").drop("phot_g_mean_mag"), "fits-back")
    finally:
        spark.conf.set(key, old)
    return _tidy(schema.clean(back))


def src_chunks(spark, sf_dir):
    """Chunks of one schema, put together again; the whole has the fingerprint of the input in any order."""
    rows = _stars(spark, sf_dir)
    whole = schema.strict_union([rows.filter(F.pmod("source_id", F.lit(3)) == i) for i in range(3)])
    # dealt anew, to as many tasks as the session's shuffles have: three would each read a third of the catalogue
    a, b = tables.fingerprint(rows), tables.fingerprint(whole.repartition(shuffle_tasks(spark)))
    c = tables.fingerprint(rows.withColumn("l", F.col("l") + 1.0)).toDF("n3", "x3", "s3")
    both = a.crossJoin(b.toDF("n2", "x2", "s2")).crossJoin(c)
    return both.select("n", ((F.col("n") == F.col("n2")) & (F.col("xor") == F.col("x2")) & (F.col("sum") == F.col("s2"))).alias("same"), ((F.col("xor") != F.col("x3")) & (F.col("sum") != F.col("s3"))).alias("differs"))


def sink_modes(spark, sf_dir):
    """Saving anew, keeping what is there, and replacing it; a job that fails while it replaces leaves the old rows."""
    rows, path = _stars(spark, sf_dir).select("source_id"), fresh_dir(spark, "modes")
    sinks.save(rows, path)
    sinks.save(rows.limit(0), path, "ignore")
    first = spark.read.parquet(path).count()
    try:
        sinks.save(rows.select(F.assert_true(F.col("source_id") < 0).cast("long").alias("source_id")), path, "overwrite")
    except Exception:
        first = spark.read.parquet(path).count() if first else 0
    sinks.save(rows.filter("source_id % 2 = 0"), path, "overwrite")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.lit(first).cast("long").alias("kept"))


def sink_map_batch(spark, sf_dir):
    """Three maps of a batch, one of which fails and one of which is not chosen."""
    from ..operators import grid

    specs = [{"name": "Bright Stars!", "least": 0, "most": 8}, {"name": "Broken", "least": "x"}, {"name": "Faint", "least": 8, "most": 99}, {"name": "Off", "enabled": False}]

    def build(spec):
        if not isinstance(spec["least"], int):
            raise ValueError("least is no number")
        rows = _stars(spark, sf_dir).filter((F.col("phot_g_mean_mag") >= spec["least"]) & (F.col("phot_g_mean_mag") < spec["most"]))
        return grid.sky_histogram(rows, W, H)

    done = sinks.run_maps(spark, specs, build, fresh_dir(spark, "maps"), "1-2, faint")
    return done.select("id", "rows", "error")


def stream_chunks(spark, sf_dir):
    """Chunk files in two arrivals, taken up in two batches each: each row once. Their number follows the session's tasks."""
    n = shuffle_tasks(spark)
    rows, folder, target, state = _stars(spark, sf_dir), fresh_dir(spark, "chunks"), fresh_dir(spark, "catalogue"), fresh_dir(spark, "state")
    for batch in (0, 1):
        rows.filter(F.pmod("source_id", F.lit(2)) == batch).repartition(n).write.mode("append").parquet(folder)
        ingest.append_new(ingest.chunks(spark, folder, rows.schema, -(-n // 2)), target, state).awaitTermination()
    back = spark.read.schema(rows.schema).parquet(target)
    return back.agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("ids"), F.round(F.sum("phot_g_mean_mag"), 5).alias("sum_g"))


def stream_histogram(spark, sf_dir):
    """The sky histogram kept up to date over two arrivals of chunks equals that of all rows at once."""
    n = shuffle_tasks(spark)
    rows, folder, target, state = _stars(spark, sf_dir), fresh_dir(spark, "chunks"), fresh_dir(spark, "cells"), fresh_dir(spark, "state")
    for batch in (0, 1):
        rows.filter(F.pmod("source_id", F.lit(2)) == batch).repartition(n).write.mode("append").parquet(folder)
        ingest.keep_histogram(ingest.chunks(spark, folder, rows.schema, -(-n // 3)), W, H, target, state, most=3).awaitTermination()
    return _tidy(ingest.read_histogram(spark, target))


#: Names under which catalogues give positions, and what a header says where the names don't.
LAYOUTS = {"equatorial": ("RA", "Dec", None), "galactic": ("GLON", "GLAT", None), "ecliptic": ("ELON", "ELAT", None), "header": ("lon", "lat", {"COORDSYS": "C"})}


def frame_guess(spark, sf_dir):
    """The same stars written in four layouts, each read back into galactic coordinates by its names or its header."""
    rows, found = view(spark, sf_dir, "sources").select("source_id", "ra", "dec"), None
    for layout, (lon, lat, header) in LAYOUTS.items():
        change = {"galactic": coords.icrs_to_galactic, "ecliptic": coords.icrs_to_ecliptic}.get(layout, lambda a, d: (a, d))
        a, d = change(F.col("ra"), F.col("dec"))
        rows.select("source_id", a.alias(lon), d.alias(lat)).write.parquet(path := fresh_dir(spark, "frame"))
        back = tables.galactic_positions(spark.read.parquet(path), header)
        one = back.select(F.lit(layout).alias("layout"), "source_id", (F.round(F.cos(F.radians("l")), 7) + 0.0).alias("gal_cos"), F.round("b", 6).alias("gal_b"))
        found = one if found is None else found.unionByName(one)
    return found


def contract_report(spark, sf_dir):
    """A catalogue with texts for magnitudes, NaN for temperatures and no parallax, held against a contract."""
    text = F.when(F.col("source_id") % 10 == 0, "n/a").otherwise(F.col("phot_g_mean_mag").cast("string"))
    rows = _stars(spark, sf_dir).select(F.col("source_id").alias("SOURCE_ID"), "l", text.alias("mag"), F.coalesce("teff_gspphot", F.lit(float("nan"))).alias("teff"))
    return schema.contract_report(rows, {"source_id": ("long", 1, None), "l": ("double", 0.0, 180.0), "mag": ("double", None, 12.0), "teff": ("double", 3000.0, 9000.0), "parallax": ("double", None, None)})


QUERIES = {f.__name__: f for f in (src_scan, src_delimited, src_ecsv, src_kinds, src_healpix, src_star_list, src_ranges, src_pull, src_fits, src_chunks, sink_modes, sink_map_batch, stream_chunks, stream_histogram, frame_guess, contract_report)}

_S = ctes("sources")
_N = f"select count(*) from (select distinct least(greatest(cast(floor((-(case when l > 180 then l - 360 else l end) + 180) * ({W}e0/360)) as bigint), 0), {W - 1}), least(greatest(cast(floor((b + 90) * ({H}e0/180)) as bigint), 0), {H - 1}) from sources where l is not null and b between -90 and 90 and "


ORACLE = {
    "src_scan": _S + "select source_id, round(l,9) as l, round(teff_gspphot,9) as teff_gspphot from sources",
    "src_delimited": _S + "select count(*) as n, count(*) filter (where source_id % 10 <> 0) as known, round(sum(l) filter (where source_id % 10 <> 0),5) as sum_l, round(sum(b) filter (where source_id % 10 <> 0),5) as sum_b, round(sum(phot_g_mean_mag) filter (where source_id % 10 <> 0),5) as sum_v from sources",
    "src_ecsv": _S + "select source_id, round(l,6) as l, case when source_id % 4 <> 0 then random_index::int end as random_index, source_id % 2 = 0 as even from sources",
    "src_kinds": _S + "select 'catalog' as kind, f as format, count(*) as n, sum(source_id)::bigint as ids, round(sum(round(l,6)),3) as sum_l, round(sum(round(phot_g_mean_mag,6)),3) as sum_g from sources, (values ('parquet'), ('fits'), ('csv'), ('tsv'), ('json')) v(f) group by f",
    "src_healpix": f"select r.pix, d.n::double as value from range(768) r(pix) left join ({maps.ORACLE['healpix_ring_density']}) d on d.pix = r.pix",
    "src_star_list": _S + "select count(*) as n, round(sum(case when source_id % 3 <> 0 then phot_g_mean_mag else 1.2e1 end),6) as sum_mag, 5.8e3 as mean_t, round(sum(b),6) as sum_b from sources",
    "src_ranges": _S + """, r as (select random_index, least(random_index // 83333, 11) as g from sources), q as (select *, row_number() over (partition by g order by random_index) as i from r where g <> 1)
select g::int as range_id, count(*) as n, max(random_index) as last from q where i <= 500 group by g""",
    "src_pull": _S + """, r as (select source_id, random_index, least(random_index // 83333, 11) as g from sources), q as (select *, row_number() over (partition by g order by random_index) as i from r)
select g::int as range_id, count(*) as n, min(random_index) as first, max(random_index) as last, count(*) as ids from q where i <= 500 group by g""",
    "src_fits": _S + "select source_id, random_index::int as index, round(l,9) as l, round(teff_gspphot,9) as teff_gspphot, 'star ' || source_id as name from sources where phot_g_mean_mag < 12.5 and random_index >= 100000 and source_id % 7 <> 0",
    "src_chunks": _S + "select count(*) as n, true as same, true as differs from sources",
    "sink_modes": _S + "select count(*) filter (where source_id % 2 = 0) as n, count(*) as kept from sources",
    "sink_map_batch": _S + f"select 'bright-stars' as id, ({_N} phot_g_mean_mag < 8)) as rows, null::varchar as error union all select 'broken', null, 'least is no number' union all select 'faint', ({_N} phot_g_mean_mag >= 8 and phot_g_mean_mag < 99)), null",
    "frame_guess": f"select layout, source_id, gal_cos, gal_b from ({stars.ORACLE['frame_ecliptic']}), (values {', '.join(f"('{x}')" for x in LAYOUTS)}) v(layout)",
    "contract_report": _S + """, q as (select count(*) as n, count(*) filter (where l is null) as l0, count(*) filter (where l > 180) as l1, count(*) filter (where source_id % 10 <> 0 and phot_g_mean_mag is null) as m0,
 count(*) filter (where source_id % 10 = 0) as m1, count(*) filter (where source_id % 10 <> 0 and phot_g_mean_mag > 12) as m2, count(*) filter (where teff_gspphot is null) as t0, count(*) filter (where teff_gspphot not between 3000 and 9000) as t2,
 count(*) filter (where source_id < 1) as s2 from sources)
select 'source_id' as "column", true as present, n as rows, 0 as missing, 0 as unreadable, s2 as outside from q union all select 'l', true, n, l0, 0, l1 from q union all select 'mag', true, n, m0, m1, m2 from q
union all select 'teff', true, n, t0, 0, t2 from q union all select 'parallax', false, n, null, null, null from q""",
    "stream_chunks": _S + "select count(*) as n, count(distinct source_id) as ids, round(sum(phot_g_mean_mag),5) as sum_g from sources where l is not null and b between -90 and 90 and phot_g_mean_mag is not null",
    "stream_histogram": _S + f", {maps._CELLS} select x, y, round(flux,9) as flux, round(temp_flux,9) as temp_flux, n from cells",
}
