"""The pipeline's stages on small tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skycat.llm import quality
from skycat.llm.queries import QUERIES
from test_dedup import groups_by_brute_force, plain_lines
from test_models import plain_grams, plain_posteriors, words

SF = "/root/testdata/sf0.001"


LETTERS = {"en": "thewandios", "de": "schungewi", "fr": "auxoilethe"}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents and labels: shouted texts, texts of digits, lines that many share, copies with a few words
    changed, repeated rows and an empty text.
    """
    rng, rows, labels = np.random.default_rng(21), [], []
    for i in range(240):
        lang = sorted(LETTERS)[i % 3]
        text = words(rng, LETTERS[lang], int(rng.integers(20, 80))).capitalize() + "."
        if i % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 12 == 1:
            text = " ".join(str(x) for x in rng.integers(1900, 2100, 30)) + "."
        elif i % 4 == 2:
            text += "\nAll rights to this text are reserved by its makers\n" + words(rng, LETTERS[lang], 12)
        elif i % 8 == 3:
            old = next((r[1] for r in reversed(rows) if r[2] == lang and r[1][1].islower() and "\n" not in r[1]), text).split()
            old[-1 if i % 16 == 3 else len(old) // 2] = "changed"
            text = " ".join(old)
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
        if i % 3 != 1 or i % 12 == 1:
            labels.append((i, int(i % 5 != 0)))
    rows += [rows[7], rows[7], (900, "", "en", "src1", 0)]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def plain_quality(spark, rows, labels):
    """The ids kept, by Counter arithmetic over plain n-grams and the operator's own noise."""
    fits = {r.doc_id for r in quality.labelled_sample(labels, 20_000).collect() if r.fits}
    grams = [plain_grams(r.text) for r in rows]
    raw, target = Counter(), Counter()
    for r, found in zip(rows, grams):
        raw.update(found)
        if r.doc_id in fits:
            target.update(found)
    n, m = sum(raw.values()), sum(target.values())
    weight = [sum(math.log((target[g] + 3) / (m * raw[g] / n + 3)) for g in found) for found in grams]
    good = {r.doc_id: r.quality for r in labels.collect()}
    held = [(w, good[r.doc_id] == 1) for r, w in zip(rows, weight) if r.doc_id in good and r.doc_id not in fits]
    line = quality.best_split(np.array([w for w, _ in held]), np.array([g for _, g in held]))
    noise = {r.doc_id: r.g for r in spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long").select("doc_id", quality.gumbel(F.col("doc_id"), 2024).alias("g")).collect()}
    keys = [w + noise[r.doc_id] for r, w in zip(rows, weight)]
    least = sorted(keys, reverse=True)[sum(w >= line for w in weight) - 1]
    return Counter(r.doc_id for r, k in zip(rows, keys) if k >= least)


def test_stages_against_brute_force(spark, planted, tmp_path):
    """Each stage's rows on what its predecessor kept, by loops and dictionaries; run() gives the last stage's."""
    docs, given, library = spark.read.parquet(f"{planted}/documents.parquet"), {}, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    labels, whole = spark.read.parquet(f"{planted}/labels.parquet"), docs.count()
    for name, stage in corpus_pipeline.STAGES:
        rows, given[name] = docs.collect(), docs.count()
        stage(spark, docs, planted).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out = docs.collect()
        if name == "quality":
            assert Counter(r.doc_id for r in out) == plain_quality(spark, rows, labels)
        elif name == "language":
            verdicts = plain_posteriors([(i, r.text, r.lang, None, r.source, "src") for i, r in enumerate(rows)], 1 << 15)
            want = [r for i, r in enumerate(rows) if verdicts[i][0] != "und" and verdicts[i][1] >= 0.5]
            assert Counter(out) == Counter(want) and len(want) < len(rows)
        elif name == "line_dedup":
            assert Counter((r.doc_id, r.text) for r in out) == Counter((i, text) for i, _, _, text in plain_lines([(r.doc_id, r.text) for r in rows]))
            assert all(r.n_chars == len(r.text) for r in out) and sum(len(r.text) for r in out) < sum(len(r.text) for r in rows)
        elif name == "near_dedup":
            groups = groups_by_brute_force({r.doc_id: r.text for r in rows})
            assert {r.doc_id for r in out} == set(groups.values()) and 5 < len(set(groups.values())) < len(groups)
        else:
            ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows}
            covered, taken = defaultdict(Counter), defaultdict(Counter)
            for r in out:
                assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                covered[r.doc_id].update(range(r.start, r.start + r.length))
                taken[r.sequence_id].update(range(r.offset, r.offset + r.length))
            times = Counter(r.doc_id for r in rows)
            assert {i: dict(c) for i, c in covered.items()} == {i: dict.fromkeys(range(len(ids[i])), times[i]) for i in times}
            assert all(set(c.values()) == {1} and max(c) + 1 == len(c) <= 4096 for c in taken.values())
    assert whole > given["language"] > given["line_dedup"] >= given["near_dedup"] > given["packing"]
    of = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert of(corpus_pipeline.run(spark, planted).collect()) == of(out)


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    again = corpus_pipeline.run(spark, SF)
    assert again.count() == docs.count() and set(again.columns) == set(docs.columns)


def test_language_stage_judges_each_row(spark):
    """An empty text among rows of a null or repeated id takes none of the others along."""
    text = "these are plain words of a common kind that any model of letters can tell"
    rows = [(i, text + " %d" % i, "en", "src1", 80) for i in range(20)]
    rows += [(None, text + " a", "en", "src1", 80), (None, text + " b", "en", "src1", 80), (None, "", "en", "src1", 0)]
    rows += [(50, text + " c", "en", "src1", 80), (50, None, "en", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.keep_languages(spark, docs, SF)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, [r for r in rows if r[1]]))
    assert got.columns == docs.columns


def test_line_stage_sets_lengths(spark):
    docs = spark.createDataFrame([(i, "a line that three documents share\nown %d" % i, "en", "src1", 40) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    assert got[0] == ("own 0", 5) and got[2][1] == len("a line that three documents share\nown 2")


def test_stages_on_odd_rows(spark, odd, none):
    """Null, empty and very long texts, null and repeated ids and clashing columns: every stage keeps the input's columns
    (and the last gives pieces), and an empty table gives no rows. Rows of no text and no words go in the language stage.
    """
    more = {"lang": F.lit("en"), "source": F.when(F.col("doc_id") % 2 == 0, F.lit("src1")), "family": F.lit("x"), "__row": F.lit("y"), "component_id": F.lit(1), "__gone": F.lit(2)}
    docs, empty = odd.withColumns(more), none.withColumns(more)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, empty, SF).count() == 0
        if name == "packing":
            assert out.count() >= docs.count()
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
    spoken = corpus_pipeline.keep_languages(spark, docs, SF)
    assert spoken.filter("text is null or trim(text) = ''").count() == 0 and spoken.count() > 0
    assert corpus_pipeline.drop_copies(spark, docs, SF).filter("text like 'The same text twice%'").select("doc_id").distinct().count() == 1


def test_registered_queries_on_given_tables(spark):
    """Every registered query runs over a whole small table and gives a row for each of its rows."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_line_dedup", "op4_fuzzy_hash", "op5_token_files", "op6_language", "op9_byte_bpe", "op10_simhash"):
        assert QUERIES[name](spark, SF).count() == documents, name


def test_registered_packing_quality_and_nearest(spark):
    """Three registered queries on whole small tables: every id in one piece, resampling as a threshold on keys, recall."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = QUERIES["op1_packing"](spark, SF).groupBy("doc_id").agg(F.sum("length").alias("got"), F.max("doc_tokens").alias("all"), F.sum(F.col("start") * 2 * F.col("length") + F.col("length") * F.col("length")).alias("square"))
    # pieces that begin where others end add up to the square of the whole
    assert pieces.count() == docs.count() and pieces.filter("got <> all or square <> all * all").count() == 0
    kept, weighed = QUERIES["op2_quality"](spark, SF).collect(), quality.weigh(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    least = min(r.gumbel_key for r in kept)
    assert 0 < len(kept) < docs.count() and Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in weighed if r.gumbel_key >= least)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = defaultdict(list)
    for r in QUERIES["op7_nearest"](spark, SF).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        best = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-score[i], ids[i]))[:20]
        mine = sorted(found[ids[q]])
        assert [r[0] for r in mine] == list(range(1, 21)) and all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {ids[i] for i in best})
    assert hits >= 0.9 * 20 * len(found) and set(found) == set(ids[ids % 20 == 0].tolist())


def test_thirteen_operators_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
