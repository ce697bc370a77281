"""Quality rules as a bitmask ledger.

`ledger` reads each text once, evaluates every rule once and stores the measurements with one bit
per failed rule. Everything after that is arithmetic on the bits: `apply_policy` turns a versioned
set of rules into verdicts, and `ablation` says from one bitwise aggregation how many documents each
rule of a policy rejects, rejects alone, or how many would be rejected without it.

Only DataFrame functions are used on the path of the data. The one thing fitted is a word list for
the rule `toxic`: words that stand in many toxic labelled documents, after many different words,
and hardly in others. It is fitted on at most SAMPLE labelled documents and holds at most TERMS
words.

Defined cases: a null or empty text has no words, all measurements 0, and fails `too_short`; null
ids, repeated rows and further columns pass through unchanged, row by row (columns named like a
result or a working column, `_w _g _l`, are replaced); a very long text is one row, in memory that
follows its words; an empty table gives an empty ledger. Cost: one scan, no shuffle (but for the bounded fit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words_of

#: Bounds of the fit: labelled documents and list entries.
SAMPLE, TERMS = 20_000, 2_000
#: Columns that the ledger makes, on the way or for good.
OWN = ("m", "fail_bits", "kept", "_w", "_g", "_l")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _letters(text: Column) -> Column:
    """Distinct lower-case runs of letters."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


def _repeated_words(windows: Column) -> Column:
    """Positions that are covered by 8-word windows of which another has the same hash: windows are
    sorted by hash, those with an equal neighbour kept, and their union measured."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last"))
        return F.aggregate(starts, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(8), x - a["last"])).alias("n"), x.alias("last")))["n"]

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ranked, covered))


def measure(docs: DataFrame, toxic_terms: list[str] = ()) -> DataFrame:
    """docs with a struct column `m` of measurements."""
    docs = docs.drop(*OWN)  # replaced
    words = docs.withColumn("_w", words_of(F.col("text")))
    n = F.size("_w")
    none = F.array().cast("array<bigint>")
    # each word is hashed once, each window from the hashes of its words
    window = lambda h, i: F.xxhash64(*[F.get(h, i + j) for j in range(8)])
    windows = let(F.transform("_w", lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= 8, F.transform(F.sequence(F.lit(0), F.size(h) - 8), lambda i: window(h, i))).otherwise(none))
    hashed = words.withColumn("_g", windows).withColumn("_l", _lines(F.col("text")))
    text = F.coalesce(F.col("text"), F.lit(""))
    terms = F.array(*[F.lit(t) for t in toxic_terms]) if toxic_terms else F.array().cast("array<string>")
    long = lambda c: c.cast("long")
    m = F.struct(
        long(n).alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        long(F.regexp_count(text, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(_repeated_words(F.col("_g"))).alias("n_repeat_words"),
        long(F.size("_l")).alias("n_lines"),
        long(F.regexp_count(text, F.lit("!!"))).alias("n_shouts"),
        long(F.size(F.array_intersect(_letters(F.col("text")), terms)) if toxic_terms else F.lit(0)).alias("n_toxic_terms"),
    )
    # a generator of one row: filters on measurements stay above it, so they are taken once
    return hashed.select(*docs.columns, F.explode(F.array(m)).alias("m"))


#: One bit a rule, in this order. A bit's meaning never changes; new rules take new bits.
RULES = {
    "too_short": lambda m: m["n_words"] < 20,
    "repetitive": lambda m: F.lit(100) * m["n_repeat_words"] > F.lit(30) * m["n_words"],
    "symbols": lambda m: F.lit(10) * m["n_symbols"] > m["n_words"],
    "shouting": lambda m: F.lit(10) * m["n_shouts"] > m["n_words"],
    "dup_lines": lambda m: F.lit(10) * m["n_dup_lines"] > F.lit(3) * m["n_lines"],
    "long_words": lambda m: m["word_chars"] > F.lit(30) * m["n_words"],
    "toxic": lambda m: m["n_toxic_terms"] >= 2,
    # one or two repeated lines say little about a short text
    "many_dup_lines": lambda m: (m["n_dup_lines"] >= 3) & (F.lit(10) * m["n_dup_lines"] > F.lit(3) * m["n_lines"]),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Policies are sets of rules; a version is never edited once used.
POLICIES = {
    "base": ("too_short", "repetitive"),
    "v1": ("too_short", "repetitive", "symbols", "shouting", "dup_lines", "long_words"),
    "v2": ("too_short", "repetitive", "symbols", "shouting", "dup_lines", "long_words", "toxic"),
    "v3": ("too_short", "repetitive", "symbols", "shouting", "long_words", "toxic", "many_dup_lines"),
}


def mask_of(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def ledger(docs: DataFrame, toxic_terms: list[str] = ()) -> DataFrame:
    """docs with `m` (measurements) and `fail_bits` (one bit a failed rule)."""
    bits = F.lit(0).cast("long")
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(rule(F.col("m")), F.lit(BIT[name])).otherwise(0).cast("long"))
    return measure(docs, toxic_terms).withColumn("fail_bits", bits)


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    return book.withColumn("kept", passes(policy))


def ablation(book: DataFrame, *policies: str) -> DataFrame:
    """A row for each policy and rule of it: documents that fail the rule, that it alone rejects, and
    that the policy without it still rejects. The ledger is read once and folded to its distinct masks,
    of which there are as many as sets of rules at most; all policies are made from these."""
    masks = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(mask_of(p)).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for p in policies for r in POLICIES[p]]
    each = masks.select("fail_bits", "n", F.explode(F.array(*cases)).alias("r")).select("n", "r.*", F.col("fail_bits").bitwiseAND(F.col("r.mask")).alias("b"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        total(F.col("b").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
        total(F.col("b") == F.col("bit")).alias("n_only"),
        total(F.col("b").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0).alias("n_rejected_without"),
    )


def fit_toxic_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> list[str]:
    """Words that mark toxic documents, from at most `sample` labelled documents (those with the
    smallest md5 of the id).

    A word counts once for each different word before it in toxic documents, so that a text with
    many copies has no more say than one document. It is taken if it does so at least 5 times and
    in one of 100 toxic documents, and is 30 times as frequent there as in clean ones.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .select("doc_id", "toxic").distinct()
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(sample)
    )
    parts = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}]+")
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", parts.alias("w"))
    sizes = chosen.agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("toxic") != 1, 1)), F.lit(0)).alias("c")).first()
    if not sizes["t"]:
        return []
    bad = (
        read.where("toxic = 1").select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("w"), F.get(F.col("w"), i - 1).alias("p")))).alias("x"))
        .select("x.w", F.coalesce("x.p", F.lit("")).alias("p")).where(F.length("w") > 1)
        .distinct().groupBy("w").agg(F.count("*").alias("t")).where((F.col("t") >= 5) & (F.lit(100) * F.col("t") >= F.lit(sizes["t"])))
    )
    good = read.where("toxic <> 1").select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    picked = (
        bad.join(good, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        .where(F.lit(2 * sizes["c"]) * F.col("t") >= F.lit(30 * sizes["t"]) * (2 * F.col("c") + 1))
        .orderBy(F.desc("t"), "w").limit(terms)
    )
    return [r["w"] for r in picked.select("w").collect()]


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, policy: str = "v3") -> DataFrame:
    """The ledger of docs with `kept` by the policy; `labels` (doc_id, toxic) fits the rule `toxic`."""
    return apply_policy(ledger(docs, fit_toxic_terms(docs, labels) if labels is not None else []), policy)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    book = quality_rules(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return book.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        (~passes("base")).alias("base_failed"), "kept", "fail_bits", "m.n_toxic_terms",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of every policy rejects, alone and with the others, from one ledger."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return ablation(ledger(docs, fit_toxic_terms(docs, labels)), *POLICIES)


ORACLE = (
    r"""
WITH lab AS (SELECT DISTINCT doc_id, toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL
             ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, toxic LIMIT 20000),
 sizes AS (SELECT count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic <> 1) AS c FROM lab),
 parts AS (SELECT toxic, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+') AS w FROM documents JOIN lab USING (doc_id)),
 pairs AS (SELECT toxic, unnest(w) AS w, unnest(list_prepend('', w[:-2])) AS p FROM parts),
 bad AS (SELECT w, count(DISTINCT p) AS t FROM pairs WHERE toxic = 1 AND length(w) > 1 GROUP BY w),
 good AS (SELECT w, count(*) AS c FROM (SELECT unnest(list_distinct(w)) AS w FROM parts WHERE toxic <> 1) GROUP BY w),
 terms AS (SELECT coalesce(list(w), []) AS terms FROM (
   SELECT bad.w FROM bad CROSS JOIN sizes LEFT JOIN good USING (w)
   WHERE bad.t >= 5 AND 100 * bad.t >= sizes.t AND 2 * sizes.c * bad.t >= 30 * sizes.t * (2 * coalesce(good.c, 0) + 1)
   ORDER BY bad.t DESC, w LIMIT 2000)),
 base AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
 wins AS (SELECT k, unnest(range(1, len(w) - 6)) AS i, w FROM base WHERE len(w) >= 8),
 named AS (SELECT k, i, array_to_string(w[i:i+7], ' ') AS g FROM wins),
 twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM named) WHERE n > 1),
 cover AS (SELECT k, sum(least(8, i - coalesce(p, i - 8))) AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM twice) GROUP BY k),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
   CAST(len(l) AS BIGINT) AS n_lines, CAST((length(text) - length(replace(text, '!!', ''))) // 2 AS BIGINT) AS n_shouts,
   CAST(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}]+')), terms)) AS BIGINT) AS n_toxic_terms
   FROM base CROSS JOIN terms LEFT JOIN cover USING (k)),
 b AS (SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
   + 8 * CAST(10 * n_shouts > n_words AS BIGINT) + 16 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT) + 32 * CAST(word_chars > 30 * n_words AS BIGINT)
   + 64 * CAST(n_toxic_terms >= 2 AS BIGINT) + 128 * CAST(n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & MASK) = 0 AS kept, fail_bits, n_toxic_terms FROM b
"""
).replace("MASK", str(mask_of("v3")))

ABLATION_ORACLE = f"""
WITH book AS (SELECT fail_bits AS b FROM ({ORACLE})),
 r AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {mask_of(p)}, '{r}', {BIT[r]})" for p in POLICIES for r in POLICIES[p])}) x(policy, mask, rule, bit))
SELECT policy, rule, count(*) FILTER (b & bit <> 0) AS n_failing, count(*) FILTER (b & mask = bit) AS n_only, count(*) FILTER ((b & mask & ~bit) <> 0) AS n_rejected_without
FROM book, r GROUP BY policy, rule
"""
