"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .words import pieces

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(65536)])


def trigrams(text: str | None, buckets: int) -> np.ndarray:
    """Hashed character triples of the lower-cased whole text; all but letters count as one separator.

    Works piece by piece, cut before white space, across which no triple reaches.
    """
    found = []
    for piece in pieces(text or ""):
        points = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        points = np.where(_letters()[np.minimum(points, 65535)], points, 0).astype(np.uint64)
        points = np.concatenate([[0], points, [0]]).astype(np.uint64)
        points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
        mixed = (points[:-2] * np.uint64(961) + points[1:-1] * np.uint64(31) + points[2:]) * np.uint64(0x9E3779B97F4A7C15)
        found.append(((mixed >> np.uint64(24)) % np.uint64(buckets))[points[1:-1] != 0].astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def normal_tag(tag: Column) -> Column:
    """The main subtag of a declared language, lower-cased; null if there is none."""
    found = F.lower(F.regexp_extract(F.trim(tag), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(found != "", found)


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`pages` with declared (the lang attribute of the html element), host, domain and suffix (of the address)."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    tag = F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)
    return pages.withColumns({"declared": F.when(tag != "", tag), "host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract(host, r"([^.]+)$", 1)})


def page_words(pages: DataFrame, html_col: str = "html", out: str = "page_words") -> DataFrame:
    """`pages` with the page's words: its html without scripts, styles, comments, tags and character references."""
    bare = F.regexp_replace(html_col, r"(?is)<(script|style|title)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[a-z!/?][^>]*>", " ")
    return pages.withColumn(out, F.regexp_replace(bare, r"(?i)&(?:[a-z]+|#x?[0-9a-f]+);?", " "))


def fit_models(docs: DataFrame, per_language: int, buckets: int) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language, the last column for unknown text).

    docs: text and declared. Every declared language is counted over at most about `per_language` documents, chosen by
    a hash of the text; unknown text is uniform over the buckets. The table goes to every task: 4 bytes a bucket and
    language, 128 KB a language with 32,768 buckets.
    """
    tagged = docs.filter("declared is not null and text is not null and text <> ''")
    sizes = cut(tagged.groupBy("declared").count())
    names = sorted(r.declared for r in sizes.collect())
    if not names:
        return [], np.full((buckets, 1), -np.log(buckets), np.float32)
    # the hash below which about per_language documents of a language lie; equal texts fall together
    limits = sizes.select("declared", F.least(F.lit(1.0), per_language / F.col("count")).alias("limit"))
    chosen = tagged.join(F.broadcast(limits), "declared").withColumn("h", F.xxhash64("text"))
    chosen = chosen.filter((F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)) < F.col("limit")).select("declared", "text")

    def count(batches):
        sums = {}

        def given():
            for name, c in sums.items():
                if len(at := np.flatnonzero(c)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at])], names=["name", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for name, text in zip(batch[0].to_pylist(), batch[1]):
                if name not in sums:
                    if len(sums) >= 64:  # partial counts go on, so that a task holds few languages at a time
                        yield from given()
                    sums[name] = np.zeros(buckets, np.int64)
                sums[name] += np.bincount(trigrams(text.as_py(), buckets), minlength=buckets)
        yield from given()

    rows = chosen.mapInArrow(count, "name string, bucket long, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n"))
    packed = rows.groupBy("name").agg(F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), "n")).alias("counts"))
    packed = cut(packed.select("name", F.col("counts.bucket").alias("at"), F.col("counts.n").alias("n")))
    table, place = np.zeros((buckets, len(names) + 1), np.float32), {n: i for i, n in enumerate(names)}
    table[:, :-1] = -np.log(buckets)
    for r in packed.toLocalIterator():
        c = np.zeros(buckets)
        c[r.at] = r.n
        table[:, place[r.name]] = np.log((c + 0.05) / (c.sum() + 0.05 * buckets))
    table[:, -1] = -np.log(buckets)
    return names, table


def _grouped(rows: DataFrame, by: str, *parent: Column) -> DataFrame:
    """(by, n, hits): the rows of a group, and a map of the text's best classes among them to their rows; and `parent`."""
    one = rows.filter(F.col(by).isNotNull()).groupBy(by, "best").agg(F.count("*").alias("hits"), *(F.max(p).alias("parent") for p in parent))
    hits = F.map_from_entries(F.collect_list(F.struct("best", "hits"))).alias("hits")
    return one.groupBy(by).agg(F.sum("hits").alias("n"), hits, *(F.max("parent").alias("parent") for _ in parent))


def _hits(i: Column) -> Column:
    return F.coalesce(F.try_element_at("hits", i), F.lit(0))


def _shares(rows: DataFrame, by: str, parent: Column, strength: float) -> DataFrame:
    """(by, shares): the smoothed share of each class among the rows of a group; `parent` is its prior, an array."""
    share = F.transform("parent", lambda p, i: (_hits(i) + strength * p) / (F.col("n") + strength))
    return _grouped(rows, by, parent).select(by, share.alias(f"{by}_share"))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = None,
    suffix_col: str | None = None,
    host_col: str | None = None,
    domain_col: str | None = None,
    per_language: int = 2000,
    buckets: int = 1 << 15,
    strength: float = 20.0,
    least: float = 0.5,
    observations: float = 20.0,
    keep_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: doc_id, language, posterior, text_language, accepted, and the string columns `keep_cols`.

    The posterior multiplies the likelihood of the text, of the declared language and of the address suffix given the
    language, and the host's prior. A text's log likelihood is a third of the sum over its character trigrams, as they
    overlap, and counts for at most `observations` trigrams of the text's mean: a text repeats its own words and
    topics, so that more of it is no more independent evidence, and the other evidence keeps a say. Priors and
    likelihoods come from grouped counts of the text's own best language over all rows: hosts are smoothed towards
    their domain, domains towards the whole corpus. Only the trigram models are fitted on bounded samples
    (`per_language` documents for each declared language). `und` stands for text like none of them; a row is accepted unless it is und or its posterior is under `least`.

    Null or empty text, or none with letters: und, unless all other evidence together is very strong. Null evidence
    doesn't count. Ties: the first language by name. Very long texts are read piece by piece. Repeated rows: each has
    its row. No declared language at all, or no rows: every row is und.
    """
    spark = docs.sparkSession
    nothing = F.lit(None).cast("string")
    small_batches(docs.sparkSession)
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        (normal_tag(F.col(declared_col)) if declared_col else nothing).alias("declared"),
        *((F.col(c).cast("string") if c else nothing).alias(a) for c, a in ((suffix_col, "suffix"), (host_col, "host"), (domain_col, "domain"))),
        *(F.col(c).cast("string").alias(c) for c in keep_cols),
    )
    names, table = fit_models(base, per_language, buckets)
    classes = len(names) + 1

    def likelihood(grams: np.ndarray) -> np.ndarray:
        parts = (grams[i : i + 4096] for i in range(0, len(grams), 4096))
        return sum(table[p].sum(0, dtype=np.float64) for p in parts) * min(1 / 3, observations / len(grams))

    def judge(batches):
        for batch in batches:
            found = []
            for text in batch[1]:
                grams = trigrams(text.as_py(), buckets)
                found.append(likelihood(grams) if len(grams) else np.array([-50.0] * (classes - 1) + [0.0]))
            found = np.array(found).reshape(len(batch), classes)
            best = pa.array(found.argmax(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch[0], *batch.columns[2:], pa.array(list(found), pa.list_(pa.float64())), best], names=kept)

    kept = ["doc_id", "declared", "suffix", "host", "domain", *keep_cols, "likelihood", "best"]
    strings = ", ".join(f"`{c}` string" for c in kept[1:-2])
    rows = cut(base.mapInArrow(judge, f"doc_id long, {strings}, likelihood array<double>, best int"))
    counts = {r.best: r["count"] for r in rows.groupBy("best").count().collect()}
    total = sum(counts.values())
    overall = F.array(*(F.lit((counts.get(i, 0) + 1.0) / (total + classes)) for i in range(classes)))

    def given(column: str) -> DataFrame:
        """(column, column_given): P(value | class), smoothed towards the value's share of all rows."""
        whole = F.array(*(F.lit(counts.get(i, 0)) for i in range(classes)))
        share = F.transform(whole, lambda c, i: (_hits(i) + strength * F.col("n") / float(max(total, 1))) / (c + strength))
        return _grouped(rows, column).select(column, share.alias(f"{column}_given"))

    domains = _shares(rows, "domain", overall, strength)
    placed = rows.join(domains, "domain", "left")
    hosts = _shares(placed, "host", F.coalesce("domain_share", overall), strength)
    fused = placed.join(hosts, "host", "left").withColumn("prior", F.coalesce("host_share", "domain_share", overall))
    score = F.zip_with("likelihood", "prior", lambda x, p: x + F.log(p))
    for column in ("declared", "suffix"):
        fused = fused.join(given(column), column, "left")
        score = F.zip_with(score, F.coalesce(f"{column}_given", F.array_repeat(F.lit(1.0), classes)), lambda x, p: x + F.log(p))
    fused = fused.withColumn("score", score).withColumn("top", F.array_max("score"))
    weight = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    label = F.array(*map(F.lit, [*names, UNKNOWN]))
    language = F.element_at(label, F.array_position("score", F.col("top")).cast("int"))
    result = fused.select("doc_id", language.alias("language"), (F.lit(1.0) / weight).alias("posterior"), F.element_at(label, F.col("best") + 1).alias("text_language"), *keep_cols)
    return result.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= least))
