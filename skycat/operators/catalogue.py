"""Variable-star and microlensing catalogues as joins of archive tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.photometry import first_positive
from ..workspace import written
from .ordering import first_rows

TAU = 2.0 * math.pi


@dataclass(frozen=True)
class CatalogueSpec:
    """Which classifier labels make up a catalogue, its class name and its default period in days."""

    name: str
    labels: tuple[str, ...]
    output_class: str
    default_period: float


# The six catalogues.
RR_LYRAE = CatalogueSpec("rr_lyrae", ("RR",), "RR_LYRAE", 0.5)
CEPHEIDS = CatalogueSpec("cepheids", ("CEP",), "CEPHEIDS", 5.0)
LBV = CatalogueSpec("lbv", ("BE|GCAS|SDOR|WR",), "LBV", 100.0)
CATACLYSMIC = CatalogueSpec("cataclysmic", ("CV",), "CATACLYSMIC", 0.2)
ZZ_CETI = CatalogueSpec("zz_ceti", ("WD",), "ZZ_CETI", 0.01)
OTHER = CatalogueSpec("other", (), "OTHER", 1.0)
CORE_LABELS = tuple(label for s in (RR_LYRAE, CEPHEIDS, LBV, CATACLYSMIC, ZZ_CETI) for label in s.labels)
CATALOGUES = {s.name: s for s in (RR_LYRAE, CEPHEIDS, LBV, CATACLYSMIC, ZZ_CETI, OTHER)}
SOURCE_COLUMNS = ("source_id", "l", "b", "parallax", "parallax_error", "phot_g_mean_mag", "teff_gspphot", "bp_rp")


def choose_catalogues(names: Sequence[str] = (), include_other: bool = False) -> list[CatalogueSpec]:
    """The named catalogues, each once, in the order given; without names the core ones. include_other adds the rest."""
    if unknown := [n for n in names if n not in CATALOGUES]:
        raise ValueError(f"unknown catalogues: {', '.join(unknown)}")
    keys = list(names) or [n for n in CATALOGUES if n != OTHER.name]
    return [CATALOGUES[k] for k in dict.fromkeys([*keys, *([OTHER.name] if include_other else [])])]


def build_catalogues(specs: Sequence[CatalogueSpec], tables: Mapping[str, DataFrame], least_score: float = 0.0, limit: int = 0) -> dict[str, DataFrame]:
    """Each chosen catalogue from the archive's tables (by name).

    limit: rows of a catalogue at most, the first by random index. Without one nothing is computed yet: a dry run explains
    or counts what it gets.
    """
    if limit < 0 or not 0.0 <= least_score <= 1.0:
        raise ValueError("limit below 0, or least_score outside 0 to 1")
    studies = {RR_LYRAE.name: ("vari_rrlyrae", "best_classification"), CEPHEIDS.name: ("vari_cepheid", "type_best_classification")}
    out = {}
    for spec in specs:
        if spec.name in studies:
            table, subclass = studies[spec.name]
            rows = study_catalogue(tables[table], tables["sources"], tables["vari_summary"], spec, subclass)
        else:
            rows = classifier_catalogue(tables["vari_classifier_result"], tables["sources"], tables["vari_summary"], spec, least_score)
        # the choice reads its rows several times, so the joins are done once before it
        out[spec.name] = first_by(written(rows, spec.name), "random_index", limit) if limit else rows
    return out


def text_or(c: Column, default: str) -> Column:
    """Trimmed text, or the default if missing or empty."""
    bare = F.trim(c)
    return F.when(F.length(bare) > 0, bare).otherwise(default)


def phase_of_id(source_id: Column) -> Column:
    return F.pmod(source_id, F.lit(1_000_003)) / 1_000_003.0 * TAU


def _placed(sources: DataFrame) -> DataFrame:
    return sources.filter("l is not null and b is not null and source_id >= 0")


def study_catalogue(study: DataFrame, sources: DataFrame, summary: DataFrame, spec: CatalogueSpec, subclass: str) -> DataFrame:
    """A catalogue from a table of light-curve fits (pf, p1_o, epoch_g, peak_to_peak_g): its sources, with summaries
    where there are any. Joins are on source_id alone, so tables bucketed by it need no shuffle.
    """
    rows = study.join(_placed(sources), "source_id").join(summary.select("source_id", "trimmed_range_mag_g_fov"), "source_id", "left")
    period = first_positive(F.col("pf"), F.col("p1_o"), default=spec.default_period)
    phase = F.when(F.col("epoch_g").isNotNull(), F.pmod(TAU * F.col("epoch_g") / period, F.lit(TAU))).otherwise(0.0)
    return rows.select(
        *SOURCE_COLUMNS, "random_index", period.alias("period"),
        first_positive(F.col("peak_to_peak_g"), F.col("trimmed_range_mag_g_fov"), default=1.0).alias("amplitude"),
        phase.alias("phase"), F.lit(spec.output_class).alias("variable_class"),
        text_or(F.col(subclass), spec.labels[0]).alias("variable_subclass"), F.lit(None).cast("double").alias("classification_score"),
    )


def classifier_catalogue(classifier: DataFrame, sources: DataFrame, summary: DataFrame, spec: CatalogueSpec, least_score: float = 0.0) -> DataFrame:
    """A catalogue of classifier results with the labels of `spec`; without labels, of all that no core catalogue has.

    The label filter is below the joins.
    """
    label = F.col("best_class_name")
    chosen = classifier.filter(label.isin(*spec.labels) if spec.labels else ~label.isin(*CORE_LABELS)).filter(F.col("best_class_score") >= least_score)
    rows = chosen.join(_placed(sources), "source_id").join(summary.select("source_id", "trimmed_range_mag_g_fov"), "source_id", "left")
    name = text_or(label, spec.output_class)
    return rows.select(
        *SOURCE_COLUMNS, "random_index", F.lit(spec.default_period).alias("period"),
        first_positive(F.col("trimmed_range_mag_g_fov"), default=1.0).alias("amplitude"),
        phase_of_id(F.col("source_id")).alias("phase"), (name if not spec.labels else F.lit(spec.output_class)).alias("variable_class"),
        name.alias("variable_subclass"), F.col("best_class_score").alias("classification_score"),
    )


def microlensing_catalogue(events: DataFrame, sources: DataFrame, parameters: DataFrame) -> DataFrame:
    """Microlensing fits with their sources and, where known, extinctions; fits, timescale and parallax in range."""
    fits = events.filter("paczynski0_te is not null and paczynski0_tmax is not null and paczynski0_u0 is not null and paczynski0_te > 0")
    near = _placed(sources).filter("parallax > 0.03 and parallax < 21")
    return fits.join(near, "source_id").join(parameters, "source_id", "left")


def first_by(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first `n` rows in an order, a number's, then by id (0: all of them); see first_rows."""
    return first_rows(rows, n, [order, "source_id"]) if n else rows


def index_range(sources: DataFrame, low: int, high: int) -> DataFrame:
    """One range of random_index, an unbiased sample of usable sources; the range reaches the scan."""
    return sources.filter((F.col("random_index") >= low) & (F.col("random_index") < high)).filter("l is not null and b is not null and phot_g_mean_mag is not null")


def select_ids(stars: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the chosen stars, the ids that aren't there)."""
    return stars.join(ids, "source_id", "left_semi"), ids.join(stars, "source_id", "left_anti")


def aligned_union(frames: Sequence[DataFrame]) -> DataFrame:
    """The union of catalogues; columns that one lacks are null."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
