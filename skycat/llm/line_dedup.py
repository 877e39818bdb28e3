"""Removing lines that many documents share, with built-in functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, written

#: The characters stripped from both ends of a line: blank and \t to \r.
BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)


def _hash(key: Column) -> Column:
    """96 bits of a key, so that different lines practically never share a value."""
    return F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"))


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Drops, from every document but the one with the largest id, each line whose key at least `min_docs` documents
    hold; keys under `min_chars` code points stay. Returns the input's columns with the new text, and n_lines (before)
    and n_dropped.

    Lines are exploded with their positions once and kept as hashes in the shared folder; counts are partial sums before
    their shuffle. Lines that over a thousandth of all rows hold are found again by a broadcast of those few, all
    others by a join. The lost positions of each text come back to it, in one shuffle of the texts, and the rest is
    put together by position, in time linear in the number of lines.

    Null or empty text: one empty line, result an empty text. A null doc_id counts as one document before all others.
    Repeated doc_ids are one document: each row loses the lines that its id loses. Ties can't occur. No rows: no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(docs[text_col], F.lit(""))
    # a row is known by its id and its text: positions hold for that text alone
    key, mark = F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))), F.xxhash64(text)
    lines = docs.select(key.alias("__key"), mark.alias("__mark"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("__key", "__mark", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    keyed = written(keyed.select("__key", "__mark", "pos", _hash(F.col("key")).alias("h")), "lines")
    held = keyed.select("__key", "h").distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("__key").alias("keeper"))
    shared = cut(held.filter(F.col("n") >= min_docs))
    lost = join_hot(keyed, shared, "h", "n", keyed.count()).filter(F.col("__key") < F.col("keeper"))
    drops = lost.groupBy("__key", "__mark").agg(F.collect_list("pos").alias("__drop"))
    joined = docs.join(drops, (key == drops["__key"]) & (mark == drops["__mark"]), "left")
    lost_at = drops["__drop"]

    def together(x: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(x.parts) - 1), x.gone)
        return F.array_join(F.transform(stays, lambda i: F.get(x.parts, i)), "\n")

    # an array of one, so that the text is split once and not for each line
    once = F.array(F.struct(F.split(text, "\n", -1).alias("parts"), lost_at.alias("gone")))
    new = F.when(lost_at.isNull(), text).otherwise(F.get(F.transform(once, together), F.lit(0)))
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    gone = F.when(lost_at.isNull(), 0).otherwise(F.size(F.array_distinct(lost_at)))
    columns = [new.alias(c) if c == text_col else docs[c] for c in kept]
    return joined.select(*columns, count.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))


ORACLE = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
e as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
s as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, pos, line, coalesce(k.doc_id < s.keeper, false) as gone from k left join s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
