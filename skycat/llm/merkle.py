"""A Merkle manifest of a dataset: digests of rows, of runs of eight digests, and proofs by descent from the root."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_row_number
from .common import cut, join_hot, narrow, written

#: Children of a node, as a number of bits of a rank: 2**3.
BITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value that no other field can be read into: its bytes' count, a colon, the value; - for null."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def tree_of(group: Column) -> Column:
    """The tree of a group's rows; trees ascend as the groups do, null first, by UTF-8 bytes."""
    return F.when(group.isNull(), "n").otherwise(F.concat(F.lit("v"), group.cast("string")))


@dataclass(frozen=True)
class Store:
    """levels: for each level from the leaves' parents up, written records (tree, place, digest, children). hot: whether
    one record of the level stands for very many nodes. roots: (tree, digest, height).
    """

    levels: list[DataFrame]
    hot: list[bool]
    roots: DataFrame

    def records(self, level: int) -> DataFrame:
        """(digest, children, uses): what the level's digests stand for; equal subtrees are one record."""
        return self.levels[level].groupBy("digest").agg(F.first("children").alias("children"), F.count("*").alias("uses"))


def build(nodes: DataFrame) -> Store:
    """Runs of eight neighbours of (tree, place, digest) become their parents until one node of each tree is left.

    A level is one grouping by (tree, run), of at most eight rows each, and is an eighth of the level below. The first
    run of a tree that has a single node left is its root; a later run of one node has a parent of its own.
    """
    levels, roots = [], None
    while True:
        run = nodes.groupBy("tree", F.shiftright("place", BITS).alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("children"))
        run = written(run.withColumn("digest", digest(F.concat_ws("", "children"))), "nodes")
        single = (F.col("place") == 0) & (F.size("children") == 1)
        top = run.filter(single).select("tree", F.col("children")[0].alias("digest"), F.lit(len(levels)).alias("height"))
        roots = top if roots is None else roots.unionByName(top)
        nodes = run.filter(~single)
        if nodes.isEmpty():
            break
        levels.append(nodes)
    hot = [False] * len(levels)
    if levels:
        uses = None
        for number, level in enumerate(levels):
            one = level.groupBy("digest").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).select(F.lit(number).alias("level"), "*")
            uses = one if uses is None else uses.unionByName(one)
        for r in uses.collect():  # a row for each level
            hot[r.level] = r.most > max(1000, r["all"] / 1000)
    return Store(levels, hot, cut(roots))


def descend(store: Store, tops: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(tree, place, children, lone, path, turns and the other columns of `tops`) of the nodes right above the leaves.

    tops: roots (tree, digest, height) with path and turns, the segments and digits that lead to them. On each level the
    digests that were reached are looked up in the level's records; a child is chosen by the next digit of a rank, its
    siblings are the next segment of the path. Requests share their way down: the nodes of a level are looked up once,
    however many leaves are asked for below. requests (tree, place of a leaf): nodes above none of them are left out.
    A tree of one leaf gives that leaf as `lone`, without a level.
    """
    extra = [c for c in tops.columns if c not in ("tree", "digest", "height", "path", "turns")]
    wanted = lambda rows, level: rows if requests is None else rows.join(requests.select("tree", F.shiftright("place", BITS * level).alias("place")).distinct(), ["tree", "place"], "left_semi")
    start = lambda height: tops.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("place"), "digest", "path", "turns", *extra)
    lone = start(0).select("tree", "place", F.array("digest").alias("children"), F.lit(True).alias("lone"), "path", "turns", *extra)
    reached = None
    for level in range(len(store.levels), 0, -1):
        here = start(level) if reached is None else reached.unionByName(start(level))
        here, records = wanted(here, level), store.records(level - 1)
        if store.hot[level - 1]:
            here, records = written(here, "reached"), cut(records)
            found = join_hot(here, records, "digest", "uses", here.count())
        else:
            found = here.join(records.drop("uses"), "digest")
        if level == 1:
            return found.select("tree", "place", "children", F.lit(False).alias("lone"), "path", "turns", *extra).unionByName(lone)
        reached = found.select("*", F.posexplode("children").alias("turn", "child")).select(
            "tree", (F.shiftleft("place", BITS) + F.col("turn")).alias("place"), F.col("child").alias("digest"), F.array_append("path", siblings(F.col("children"), F.col("turn"))).alias("path"), F.array_append("turns", F.col("turn")).alias("turns"), *extra)
    return lone


def siblings(children: Column, turn: Column) -> Column:
    """The digests of a run but the chosen one, one after the other."""
    return F.concat_ws("", F.filter(children, lambda x, i: i != turn))


def fold(leaf: Column, segments: Column, turns: Column) -> Column:
    """The root that a leaf leads to: at each level its siblings stand around it, then the run is hashed."""
    pairs = F.zip_with(segments, turns, lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    step = lambda node, x: digest(F.substring(x["s"], F.lit(1), x["t"] * 64), node, F.substring(x["s"], x["t"] * 64 + 1, F.length(x["s"])))
    return F.aggregate(pairs, leaf, step)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", requests: DataFrame | None = None, digests_only: bool = True) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; else also segments (the siblings
    from the leaf's level to the root's, each level's one after the other) and turns (the leaf's places in those runs).

    A leaf is the digest of the fields. In each group, leaves ascend by doc_id and runs of eight are hashed to its
    subroot; subroots, ordered by group, likewise to the root. folded_root is what the proof leads to from a tampered
    leaf where 3 divides the crc32 of the doc_id (A-Z of its text in lower case), else from the leaf itself.
    requests (doc_id): proofs of these documents alone; null ids ask for rows without an id.

    Null doc_ids come first in their group and are not tampered with; equal doc_ids go by leaf digest, equal rows in an
    order of their own: each has its own place and proof. Null group: a group of its own, the first. A text of any
    length is hashed whole. Other columns aren't read. No rows: no rows.
    """
    rows = narrow(docs, **{f"f{i}": c for i, c in enumerate(fields)}, doc_id=id_col, group=group_col)
    columns = [F.col(f"f{i}") for i in range(len(fields))]
    low = F.translate(columns[list(fields).index(text_col)], string.ascii_uppercase, string.ascii_lowercase)
    changed = [low if c == text_col else columns[i] for i, c in enumerate(fields)]
    tamper = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    leaves = rows.select("doc_id", tree_of(F.col("group")).alias("tree"), digest(*map(field, columns)).alias("leaf"), F.when(tamper, digest(*map(field, changed))).alias("other"))
    placed = with_row_number(leaves, "place", ["doc_id", "leaf"], 0, ["tree"])
    bottom = build(placed.select("tree", "place", F.col("leaf").alias("digest")))
    # the trees' roots are the leaves of one more tree
    tops = cut(with_row_number(bottom.roots.select("tree", "digest", "height"), "place", ["tree"], 0))
    upper = build(tops.select(F.lit("").alias("tree"), "place", "digest"))
    root = upper.roots.first()
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    above = descend(upper, upper.roots.withColumns({"path": empty("string"), "turns": empty("int")}))
    turn = F.col("place").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    ways = _ends(tops.withColumn("node", F.lit("")), above, "node", turn).select("tree", "digest", "height", F.col("digest").alias("subroot"), "path", "turns")
    asked = placed if requests is None else placed.join(F.broadcast(requests) if requests.count() <= 1_000_000 else requests, placed["doc_id"].eqNullSafe(requests[requests.columns[0]]), "left_semi")
    nodes = descend(bottom, ways, None if requests is None else cut(asked.select("tree", "place")))
    found = _ends(asked, nodes, "tree", turn)
    # from the root down so far: a proof reads upwards
    found = found.withColumns({"segments": F.reverse("path"), "turns": F.reverse("turns")})
    out = found.select("doc_id", "leaf", "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), F.sha2(F.concat_ws("", "segments"), 256).alias("proof_sha256"), fold(F.coalesce("other", "leaf"), F.col("segments"), F.col("turns")).alias("folded_root"), "segments", "turns")
    out = out.withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.drop("segments", "turns") if digests_only else out


def _ends(leaves: DataFrame, nodes: DataFrame, tree: str, turn: Column) -> DataFrame:
    """`leaves` with the whole path and turns from the root: each meets the node above it, which eight share at most."""
    nodes = nodes.select(F.col("tree").alias("__tree"), F.col("place").alias("__run"), "children", "lone", *(c for c in nodes.columns if c not in ("tree", "place", "children", "lone")))
    both = leaves.join(nodes, (leaves[tree] == nodes["__tree"]) & (F.shiftright(leaves["place"], BITS) == nodes["__run"]))
    segment, at = siblings(F.col("children"), turn), turn
    path = F.when(F.col("lone"), F.col("path")).otherwise(F.array_append("path", segment))
    turns = F.when(F.col("lone"), F.col("turns")).otherwise(F.array_append("turns", at))
    return both.withColumns({"path": path, "turns": turns}).drop("__tree", "__run", "children", "lone")


def _oracle(levels: int = 9, upper: int = 4) -> str:
    """The manifest of `documents` in SQL, for groups of up to 8**levels rows and 8**upper groups."""
    value = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(f"({value(text if c == 'text' else c)})" for c in FIELDS) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        "with tab as (select list(list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t from range(256) r(i))",
        "crc as (select doc_id, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from (select distinct doc_id from documents where doc_id is not null), tab)",
        f"leaves as (select d.doc_id, coalesce('v' || lang, 'n') as tree, {leaf('text')} as leaf, case when crc % 3 = 0 then {leaf(low)} end as other from documents d left join crc on d.doc_id = crc.doc_id)".replace("doc_id is null", "d.doc_id is null").replace("doc_id::varchar)::varchar || ':' || doc_id::varchar", "d.doc_id::varchar)::varchar || ':' || d.doc_id::varchar"),
        "d0 as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, coalesce(other, leaf) as cur, '' as proof from leaves)",
        "n0 as (select tree, place, leaf as digest, count(*) over (partition by tree) as n from d0)",
    ]

    def climb(prefix: str, count: int) -> None:
        d, n = f"d{prefix}", f"n{prefix}"
        for k in range(count):
            parts.append(f"r{prefix}{k} as (select tree, place // 8 as run, list(digest order by place) as l, n from {n}{k} group by tree, place // 8, n)")
            parts.append(f"{n}{k + 1} as (select tree, run as place, case when n = 1 then l[1] else sha256(array_to_string(l, '')) end as digest, (n + 7) // 8 as n from r{prefix}{k})")
            parts.append(f"""{d}{k + 1} as (select d.* replace (d.place // 8 as place, case when n = 1 then cur else sha256(array_to_string(list_transform(l, lambda x, i: case when i = d.place % 8 + 1 then cur else x end), '')) end as cur,
 proof || case when n = 1 then '' else array_to_string(list_filter(l, lambda x, i: i <> d.place % 8 + 1), '') end as proof) from {d}{k} d join r{prefix}{k} r on d.tree = r.tree and d.place // 8 = r.run)""")

    climb("", levels)
    parts.append(f"tops as (select tree, digest, row_number() over (order by tree) - 1 as place from n{levels})")
    parts.append(f"du0 as (select d.* replace ('' as tree, t.place as place), t.digest as subroot from d{levels} d join tops t on d.tree = t.tree)")
    parts.append("nu0 as (select '' as tree, place, digest, count(*) over () as n from tops)")
    climb("u", upper)
    return ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, cur as folded_root, cur = digest as verified from du{upper}, nu{upper}"


ORACLE = _oracle()
