"""Merkle manifest of a dataset: a tree of digests per group of rows, and one over the groups.

A row's leaf is the SHA-256 of its fields. Within a group (a source) leaves stand in order; while more
than one node is left, every FAN consecutive nodes become the digest of their joined hex digests. What
remains is the group's subroot; the subroots, in order of their groups, give the root likewise. A row's
proof lists, level by level, the digests left and right of its own node, so that anyone who has the row
and the root can check it without the other rows.

Leaves are hashed where the text lies; from there on only digests move. Places within a group come from
a range partitioning and its counts, so that a group that holds a third of all rows is ranked by many
tasks. Places are cut into blocks of FAN ** DEPTH nodes, aligned to whole subtrees. Each block is an
Arrow table on which DuckDB runs the level queries (ordered string_agg, sha256); a block gives one node
of the next round, of which Spark makes blocks again. On the way back a block meets the proof of its own
root and gives those of its nodes. A block holds FAN ** DEPTH rows at most, whatever the group's size.

Defined cases: nulls in any field have a digest of their own (`-`); a null group comes first, null ids
last; rows with equal ids stand in order of their leaves, equal rows are leaves of their own; a lone
leaf is its group's subroot and a lone subroot the root, with empty proofs; of a table's columns only
those named are read, so that no other can clash; an empty table gives an empty manifest.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, freed_shuffles, table, widened

#: Nodes that make one of the next level, and levels that a block holds.
FAN, DEPTH = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<left: string, right: string>>"


def leaf_of(fields: list[Column]) -> Column:
    """The digest of fields: `-` for null, else length in bytes, `:` and the value, one after the other."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by its proof."""
    return F.aggregate(proof, leaf, lambda node, beside: F.sha2(F.concat(beside["left"], node, beside["right"]), 256))


@functools.cache
def _duckdb():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def _levels(n: int, depth: int) -> int:
    """Levels of a block of a group with n nodes in this round."""
    k = 0
    while k < depth and n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def _level_queries(levels: int, depth: int) -> str:
    """Common table expressions: n0, n1, ... the nodes of each level; r0, r1, ... the joined digests of each run of FAN of them."""
    out = [f"n0 AS (SELECT pos % {FAN**depth} AS i, digest AS d FROM nodes)"]
    for k in range(levels):
        out.append(f"r{k} AS MATERIALIZED (SELECT i // {FAN} AS run, string_agg(d, '' ORDER BY i) AS s FROM n{k} GROUP BY run)")
        out.append(f"n{k + 1} AS (SELECT run AS i, sha256(s) AS d FROM r{k})")
    return "WITH " + ", ".join(out)


def _block_roots(depth: int):
    """A function that gives the root of a block."""

    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        n = nodes.column("n")[0].as_py()
        levels = _levels(n, depth)
        con = _duckdb().cursor()
        con.register("nodes", nodes)
        root = con.execute(f"{_level_queries(levels, depth)} SELECT d FROM n{levels}").fetchone()[0]
        con.close()
        return pa.table({"key": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // FAN**depth)], pa.int64()), "digest": pa.array([root], pa.string())})

    return run


def _block_proofs(depth: int, schema: pa.Schema):
    """A function that gives the nodes of a block their proofs: the block's own levels, then those of its root."""

    def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return schema.empty_table()
        levels = _levels(nodes.column("n")[0].as_py(), depth)
        con = _duckdb().cursor()
        con.register("nodes", nodes)
        con.register("above", above)
        at = f"(pos % {FAN**depth})"
        place = [f"64 * ({at} // {FAN**k} % {FAN})" for k in range(levels)]
        beside = [f"{{'left': left(r{k}.s, {place[k]}), 'right': substr(r{k}.s, {place[k]} + 65)}}" for k in range(levels)]
        joins = " ".join(f"JOIN r{k} ON r{k}.run = {at} // {FAN ** (k + 1)}" for k in range(levels))
        proof = f"list_concat([{', '.join(beside)}], (SELECT proof FROM above))" if levels else "(SELECT proof FROM above)"
        out = con.sql(f"{_level_queries(levels, depth)} SELECT nodes.*, {proof} AS proof, (SELECT subroot FROM above) AS subroot, (SELECT root FROM above) AS root FROM nodes {joins}").to_arrow_table()
        con.close()
        return out.select(schema.names).cast(schema)

    return run


def _places(scratch: Scratch, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows (key, ...) with their place among the rows of their key and the number of these."""
    dealt = rows.repartitionByRange(F.col("key"), *order).sortWithinPartitions(F.col("key"), *order)
    dealt = scratch.keep(dealt.withColumn("at", F.monotonically_increasing_id()), name)  # task number * 2 ** 33 + row number
    part = F.shiftright("at", 33)
    runs = dealt.groupBy("key", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    key = Window.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(key).alias("n"))
    return dealt.withColumn("part", part).join(starts, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(nodes: DataFrame, depth: int):
    return nodes.groupBy("key", F.floor(F.col("pos") / FAN**depth).alias("block"))


def _climb(scratch: Scratch, nodes: DataFrame, depth: int, name: str) -> list[DataFrame]:
    """The nodes of each round, up to the one with one node a key."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        made = _blocks(rounds[-1].select("key", "pos", "n", "digest"), depth).applyInArrow(_block_roots(depth), "key string, pos long, n long, digest string")
        rounds.append(scratch.keep(made, f"{name}{len(rounds)}"))
        most = -(-most // FAN**depth)
    return rounds


def _descend(rounds: list[DataFrame], depth: int, top: DataFrame) -> DataFrame:
    """The nodes of the first round with their proofs, from top (key, pos, proof, subroot, root) of the last."""
    new = ["key", "pos", "proof", "subroot", "root"]
    if len(rounds) == 1:
        return rounds[0].join(top.select(new), ["key", "pos"])
    for nodes in reversed(rounds[:-1]):
        schema = widened(nodes, f"proof {_PROOF}, subroot string, root string")
        top = _blocks(nodes, depth).cogroup(top.select(new).groupBy("key", "pos")).applyInArrow(_block_proofs(depth, to_arrow_schema(schema)), schema)
    return top


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """A row for each row of docs: `order`, leaf, proof (array of left and right digests, from the leaf
    up), subroot, root and the columns `carry`, which may be any but these."""
    spark = docs.sparkSession
    col = lambda c: F.col(f"`{c}`")
    with freed_shuffles(spark), Scratch(spark, "merkle") as scratch:
        # nulls and strings stay apart and in order
        key = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))
        payload = F.struct(col(order).alias("order"), *(c.alias(f"c{i}") for i, c in enumerate((carry or {}).values())))
        leaves = scratch.keep(docs.select(key.alias("key"), leaf_of([col(f) for f in fields]).alias("digest"), payload.alias("row")), "leaves")
        placed = scratch.keep(_places(scratch, leaves, [F.col("row.order").asc_nulls_last(), F.col("digest")], "ordered"), "placed")
        scratch.free("leaves", "ordered")
        rounds = _climb(scratch, placed, depth, "block")
        groups = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
        groups = scratch.keep(_places(scratch, groups, [F.col("group")], "sources"), "groups")
        above = _climb(scratch, groups, depth, "top")
        root = above[-1].select("key", "pos", F.array().cast(_PROOF).alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
        proved = _descend(above, depth, root)
        top = proved.select(F.col("group").alias("key"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root")
        out = _descend(rounds, depth, scratch.keep(top, "proved"))
        named = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry or {})]
        return scratch.give(out.select(F.col("row.order").alias(order), F.col("digest").alias("leaf"), "proof", "subroot", "root", *named))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 != 0
    changed = F.when(~odd & F.contains("text", F.lit("\n")), leaf_of([F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]))
    rows = manifest(docs, carry={"changed": changed})
    beside = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    found = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), found.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS id, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
 crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, [CASE WHEN i % 8 = 0 THEN ascii(id[i // 8 + 1]) ELSE 0 END FOR i IN range(8 * len(id))]),
    lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295) AS crc FROM docs),
 leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen FROM crc),
 placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
 tree AS (
  SELECT source, 0 AS level, i, n, leaf AS d FROM placed
  UNION ALL
  SELECT source, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY source, level, i // 3),
 runs AS (SELECT source, level, i // 3 AS run, string_agg(d, '' ORDER BY i) AS s FROM tree WHERE n > 1 GROUP BY ALL),
 subroots AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
 toptree AS (
  SELECT 0 AS level, i, n, subroot AS d FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM toptree WHERE n > 1 GROUP BY level, i // 3),
 topruns AS (SELECT level, i // 3 AS run, string_agg(d, '' ORDER BY i) AS s FROM toptree WHERE n > 1 GROUP BY ALL),
 folds AS (
  SELECT doc_id, leaf, source, 0 AS level, i, n, seen AS f, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, leaf, source, level + 1, i // 3, (n + 2) // 3, sha256(left(s, 64 * (i % 3)) || f || substr(s, 64 * (i % 3) + 65)), proof || left(s, 64 * (i % 3)) || substr(s, 64 * (i % 3) + 65)
  FROM folds JOIN runs USING (source, level) WHERE n > 1 AND run = i // 3),
 topfolds AS (
  SELECT doc_id, leaf, subroot, 0 AS level, s.i, s.n, f, proof FROM folds JOIN subroots AS s ON folds.source IS NOT DISTINCT FROM s.source WHERE folds.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, level + 1, i // 3, (n + 2) // 3, sha256(left(s, 64 * (i % 3)) || f || substr(s, 64 * (i % 3) + 65)), proof || left(s, 64 * (i % 3)) || substr(s, 64 * (i % 3) + 65)
  FROM topfolds JOIN topruns USING (level) WHERE n > 1 AND run = i // 3)
SELECT doc_id, leaf, subroot, (SELECT d FROM toptree WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT d FROM toptree WHERE n = 1) AS verified
FROM topfolds WHERE n = 1
"""
