"""Quality classification by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow, small
from .words import tokens

_MIX = np.uint64(0x9FB21C651E98DF25)

class Grams:
    """The hashed n-grams of a whole text: words, pairs of words, and triples of token shapes, in `buckets` buckets."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)

    def __call__(self, text: str | None) -> Iterator[np.ndarray]:
        """Yields bucket numbers, a part of the text at a time; n-grams reach over the parts."""
        before = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for words, shapes in tokens(text):
            first, second = (np.concatenate([b, x]) for b, x in zip(before, (words, shapes)))
            pairs = first[1:] if len(before[0]) == 2 else first
            kinds = [words + np.uint64(1), pairs[:-1] * np.uint64(31) + pairs[1:] * np.uint64(7919) + np.uint64(2)]
            kinds.append(second[:-2] * np.uint64(961) + second[1:-1] * np.uint64(31) + second[2:] + np.uint64(3))
            yield (((np.concatenate(kinds) * _MIX) >> np.uint64(33)) % self.buckets).view(np.int64)
            before = first[-2:], second[-2:]


def labelled_sample(labels: DataFrame, most: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, label, fits): at most `most` labelled ids of each class, in the order of a hash; one label per id, the
    least. Half of class 1 is for fitting the target model, all the rest for the threshold.
    """
    one = narrow(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label in (0, 1)")
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    both = one.filter("label = 1").orderBy(*order).limit(most).unionByName(one.filter("label = 0").orderBy(*order).limit(most))
    return both.withColumn("fits", (F.col("label") == 1) & (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0))


def fit_ratio(docs: DataFrame, sample: DataFrame, buckets: int, smooth: float = 3.0) -> np.ndarray:
    """log(target / raw) of each n-gram bucket.

    docs: doc_id, text. The raw model counts all documents, the target model those that `sample` marks for fitting; tasks add up
    their counts before one small grouped sum, of which the driver gets one row for each bucket.
    """
    marked = docs.join(F.broadcast(sample), "doc_id", "left").select("text", F.coalesce(F.col("fits"), F.lit(False)).alias("target"))

    def count(batches):
        grams, counts = Grams(buckets), np.zeros((2, buckets), np.int64)
        held: tuple[list, list] = ([], [])

        def add(side: int) -> None:
            if held[side]:
                np.add(counts[side], np.bincount(np.concatenate(held[side]), minlength=buckets), out=counts[side])
                held[side].clear()

        size = 0
        for batch in batches:
            for text, good in zip(batch[0], batch[1].to_pylist()):
                for found in grams(text.as_py()):
                    held[good].append(found)
                    size += len(found)
                    if size > 1 << 18:
                        add(0), add(1)
                        size = 0
        add(0), add(1)
        raw = counts.sum(0)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    sums = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return np.zeros(buckets)
    # the target model is smoothed towards the raw one, so that n-grams too rare to judge weigh nothing
    return np.log((target + smooth) / (target.sum() * raw / raw.sum() + smooth))


def log_weights(marked: DataFrame, ratio: np.ndarray) -> DataFrame:
    """`marked` (doc_id, __id, __mark, text) with log_weight in place of text: the sum of its n-grams' log ratios."""
    def weigh(batches):
        grams = Grams(len(ratio))
        for batch in batches:
            found = [sum(float(ratio[g].sum()) for g in grams(t.as_py())) for t in batch[3]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], names=["doc_id", "__id", "__mark", "log_weight"])

    return marked.select("doc_id", "__id", "__mark", "text").mapInArrow(weigh, "doc_id long, __id long, __mark long, log_weight double")


def best_split(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the best balanced accuracy, midway between its neighbours; 0 without both classes."""
    if good.all() or not good.any():
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    gain = np.cumsum(~g) / (~g).sum() - np.cumsum(g) / g.sum()
    gain[:-1][s[1:] == s[:-1]] = -2
    i = int(np.argmax(gain))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def gumbel(key: Column, seed: int) -> Column:
    """A standard Gumbel variate from a hash of the key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int, step: float = 2.0**-16, bins: int = 4096) -> float | None:
    """A number t such that at least k keys (column key) are at or above it, and fewer are above t + `step`.

    The interval that holds the k-th key is narrowed by grouped counts of `bins` parts at a time; at most that many
    rows reach the driver, never the keys.
    """
    ends = keys.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("n")).first()
    if k <= 0 or not ends.n:
        return None
    low, high, left = ends.low, ends.high, min(k, ends.n)
    if left == ends.n:
        return low
    while high - low > step:
        width = (high - low) / bins
        part = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        for r in sorted(inside.collect(), key=lambda r: -r.part):
            if r.n >= left:
                break
            left -= r.n
        if (r.least, r.most) == (low, high):
            break
        low, high = r.least, r.most
    return low


def _identity(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart: the id (null: the least number) and a hash of id and text."""
    key = F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))
    return [key, F.xxhash64(key, text)]


def weigh(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    buckets: int = 1 << 16,
    share: float | None = None,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, log_weight, gumbel_key, kept, and what tells rows apart (__id, __mark); see resample."""
    texts = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = cut(labelled_sample(labels, sample))
    ratio = fit_ratio(texts, known, buckets)
    marks = [c.alias(name) for c, name in zip(_identity(F.col("doc_id"), F.col("text")), ("__id", "__mark"))]
    marked = log_weights(texts.select("doc_id", *marks, "text"), ratio)
    scored = cut(marked.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    some = scored.join(F.broadcast(known.filter(~F.col("fits"))), "doc_id").select("log_weight", "label").limit(2 * sample).toPandas()
    if share is None:
        line = best_split(some["log_weight"].to_numpy(), some["label"].to_numpy() == 1) if len(some) else 0.0
        k = scored.filter(F.col("log_weight") >= line).count()
    else:
        k = round(share * scored.count())
    bound = kth_largest(scored.select(F.col("gumbel_key").alias("key")), k)
    return scored.withColumn("kept", F.lit(False) if bound is None else F.col("gumbel_key") >= bound)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that importance resampling keeps, with the input's columns. options: those of weigh.

    A document's weight is the ratio of two hashed n-gram models, of target text (documents labelled 1, at most
    `sample` ids) and of raw text (all documents). Gumbel top-k draws k documents without replacement in proportion to
    their weights: the k largest of log weight + Gumbel noise. k is `share` of all documents or, by default, the
    number of documents above the log weight that best separates the part of the labelled sample that the models don't
    fit. Texts are read twice, to count and to weigh; the rejected rows' hashes then meet the input.

    Null or empty text: weight 1 (log 0). Null doc_ids share one noise value. Repeated rows are kept or dropped
    alike; rows tied with the k-th are kept. No labels of a class: the threshold is 0. No rows: no rows.
    """
    scored = weigh(docs, labels, id_col=id_col, text_col=text_col, **options)
    gone = small(cut(scored.filter(~F.col("kept")).select("__id", "__mark").distinct()))
    key, mark = _identity(docs[id_col], docs[text_col])
    return docs.join(gone, (key == gone["__id"]) & (mark == gone["__mark"]), "left_anti")
