"""Line de-duplication by content-defined chunks of lines.

Each line is hashed; a rolling hash over the last WIDTH line hashes closes a chunk where it is 0
modulo EVERY, so that a boundary depends on the lines beside it and not on what was inserted
further up. Chunks of two or more non-blank lines that occur more than once in the whole corpus are
removed, all but their first occurrence (smallest document, then position). Hashes only choose the
candidates: occurrences are equal if their bytes are.

The plan moves (hash, document, position) of multi-line chunks, pre-aggregated per hash; texts of
chunks only where the hash repeats, pre-aggregated per text; and each text once, to meet its list of
removals. What repeats is written before it is joined back, so that Spark can split a passage that
a third of the documents share over several tasks. What is joined grows with the documents, so joins
sort at every size and never broadcast. Only DataFrame functions are used.

Defined cases: a null text stays null and an empty one empty; documents are ordered by doc_id, null
last, then by text; rows with the same doc_id and text count as one document and get the same
result; text between kept chunks is kept byte for byte, with its '\n'; a very long text is one row,
as long in memory as its lines; further columns pass through, but those named like a result are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, freed_shuffles, let, table

#: Lines that the rolling hash sees, and lines that a chunk holds on average.
WIDTH, EVERY = 2, 4
RESULTS = ("n_lines", "n_removed_lines", "n_removed_chunks")


def _line_hash(line: Column) -> Column:
    """The first 28 bits of the MD5, as a long: small enough to be combined without overflow."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _chunks(text: Column) -> Column:
    """array<struct<at: first line, n: lines, text>>: `text` joined again by '\\n'."""

    def of(x: Column) -> Column:
        lines, hashes = x["lines"], x["hashes"]
        n = F.size(lines)
        rolled = lambda i: F.pmod(F.get(hashes, i) + F.coalesce(F.get(hashes, i - 1), F.lit(0).cast("long")) * 31, F.lit(EVERY))
        ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (rolled(i) == 0))
        return let(ends, lambda e: F.transform(e, lambda end, k: let(
            F.coalesce(F.get(e, k - 1) + 1, F.lit(0)),
            lambda start: F.struct(start.alias("at"), (end - start + 1).alias("n"), F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("text")),
        )))

    split = let(F.split(text, "\n"), lambda s: F.struct(s.alias("lines"), F.transform(s, _line_hash).alias("hashes")))
    return let(split, of)


def _solid(chunk: Column) -> Column:
    """Whether a chunk holds two or more lines with something in them."""
    return (chunk["n"] >= 2) & chunk["text"].rlike(r"[^\x20\x09-\x0D\n][^\n]*\n(?s:.*)[^\x20\x09-\x0D]")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with `text` less the repeated chunks, and n_lines, n_removed_lines, n_removed_chunks."""
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)  # replaced
    with freed_shuffles(spark), Scratch(spark, "lines") as scratch:
        key = [F.col("doc_id").alias("_id"), F.md5(F.col("text")).alias("_t")]
        pieces = docs.where(F.col("text").isNotNull()).select(*key, F.explode(_chunks(F.col("text"))).alias("c")).where(_solid(F.col("c")))
        place = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("d"), F.col("_t").alias("t"), F.col("c.at").alias("at"))
        named = pieces.select("_id", "_t", "c", place.alias("p"), F.unhex(F.md5(F.col("c.text"))).alias("h"))
        often = named.groupBy("h").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo <> hi").select("h")
        often = scratch.keep(often, "hash")
        # byte comparison: chunks are equal if their texts are
        again = named.join(often.hint("merge"), "h", "left_semi")
        again = scratch.keep(again.select("_id", "_t", "p", "h", F.col("c.at").alias("at"), F.col("c.n").alias("n"), F.col("c.text").alias("bytes")), "again")
        first = again.groupBy("h", "bytes").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo <> hi").select("h", "bytes", "lo")
        first = scratch.keep(first, "first")
        drop = again.join(first.hint("merge"), ["h", "bytes"]).where("p <> lo").select("_id", "_t", "at", "n").distinct()
        drop = drop.groupBy("_id", "_t").agg(F.collect_set("at").alias("_drop"), F.sum("n").alias("_lines"))
        drop = scratch.give(drop).withColumnsRenamed({"_id": "_i", "_t": "_u"})
    # rows travel as one struct, so that no name can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("_d"), F.md5("text").alias("_t"))
    full = rows.join(drop.hint("merge"), F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_u")), "left")
    text = F.col("row.text")
    rest = F.array_join(F.transform(F.filter(_chunks(text), lambda c: ~F.array_contains(F.col("_drop"), c["at"])), lambda c: c["text"]), "\n")
    zero = F.lit(0).cast("long")
    return full.select(
        *[F.when(F.col("_drop").isNull(), text).otherwise(rest).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns],
        F.when(text.isNull(), zero).otherwise(F.size(F.split(text, "\n")).cast("long")).alias("n_lines"),
        F.coalesce(F.col("_lines").cast("long"), zero).alias("n_removed_lines"),
        F.coalesce(F.size("_drop").cast("long"), zero).alias("n_removed_chunks"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text")


ORACLE = r"""
WITH lines AS (SELECT doc_id, md5(text) AS t, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
 each AS (SELECT doc_id, t, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM lines),
 hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM each),
 ends AS (SELECT *, i = n - 1 OR (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id, t ORDER BY i), 0)) % 4 = 0 AS e FROM hashed),
 parts AS (SELECT *, coalesce(sum(CAST(e AS INT)) OVER (PARTITION BY doc_id, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ends),
 chunks AS (SELECT doc_id, t, c, min(i) AS pos, count(*) AS n, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS solid,
   string_agg(line, chr(10) ORDER BY i) AS b FROM parts GROUP BY ALL),
 ranked AS (SELECT *, CASE WHEN solid >= 2 THEN row_number() OVER (PARTITION BY (solid >= 2), b ORDER BY doc_id NULLS LAST, t, pos) ELSE 1 END AS k FROM chunks),
 kept AS (SELECT doc_id, t, coalesce(string_agg(b, chr(10) ORDER BY pos) FILTER (k = 1), '') AS text, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS n_removed_lines,
   count(*) FILTER (k > 1) AS n_removed_chunks FROM ranked GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(kept.n_removed_lines, 0) AS n_removed_lines,
  coalesce(kept.n_removed_chunks, 0) AS n_removed_chunks, kept.text
FROM documents d LEFT JOIN kept ON d.doc_id IS NOT DISTINCT FROM kept.doc_id AND md5(d.text) = kept.t
"""
