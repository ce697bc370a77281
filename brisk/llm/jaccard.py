"""Similarity join of documents on the Jaccard similarity of their 5-word shingles.

Rare-first prefix filtering: shingles are put into one global order by the number of documents that
hold them, and two sets with Jaccard similarity t or more share one of the first n - ceil(t n) + 1
shingles of each. Shingles that one document alone has come first and can match nothing, so a
document of which fewer than ceil(t n) shingles are shared is out at once, and only the shared part of
a prefix is joined.

1. One scan cuts and hashes the texts. A task gathers chunks of documents and sends the shingles of a
   chunk to buckets by their hash, as arrays. A shingle that several documents of the chunk have is
   sent once, with its number, so no shingle has more entries in a bucket than there are chunks.
   Buckets add up and answer each chunk; the chunk then has the count of each of its shared
   shingles, and writes prefixes and sets of the documents that can have partners at all.
2. Documents with equal sets are one class, named by a 128-bit hash of the set.
3. Classes that share a prefix shingle form a list. No list is expanded into all its pairs. In a
   round the classes of each list meet its hubs (those that share most, as an original does with its
   near copies) under the length and positional filters; distinct pairs pass a suffix filter and the
   exact count, once each. Then the components of all links so far are closed, and lists within one
   component are done. Rounds have GROWTH times as many hubs each and go on while they find links;
   the last one lets what is outside the largest component of an open list meet all the others of it.
4. Components come from label propagation with pointer jumping, in written rounds.

Sets are compared as sets of 64-bit shingle hashes.

Defined cases: null, empty and blank texts have an empty set and link with nothing, not even each
other; texts of 1 to 4 words have one shingle, the whole sequence; only A-Z are lower-cased; very
long texts are hashed in steps and cost memory by their number of words; the smallest doc_id ignores
nulls and is null only if all of a component are; rows with equal doc_id are different documents;
further columns pass through, but those named like a result are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, attach, freed_shuffles, lean, mix, shingle_hashes, small_batches, table

#: Words of a shingle; similarity in hundredths.
K, PERCENT = 5, 80
#: Each round has so many times the hubs of the one before.
GROWTH = 16
#: Text bytes of a step; shingles and documents of a chunk.
STEP, CHUNK, MOST_DOCS = 2 << 20, 1 << 20, 1 << 16
#: Text bytes whose shingles make a bucket, and the least number of buckets.
BUCKET, LEAST_BUCKETS = 8 << 20, 16
#: Documents for each task that writes a table of a round, and the least number of these tasks.
TASK_DOCS, LEAST_TASKS = 4096, 12
_U = np.uint64


def shingle_set(words: np.ndarray, rolled: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted distinct shingles of one text. `rolled` are the hashes of its runs of k words."""
    if not len(words):
        return np.zeros(0, _U)
    if len(words) < k:
        return mix(shingle_hashes(words, len(words)) + _U(len(words)))
    return np.unique(rolled)


def needed(n: int, percent: int = PERCENT) -> int:
    """The least of a set of n that a partner shares."""
    return -(-percent * n // 100)


def overlap_needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def linked(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int = PERCENT) -> bool:
    """Whether sets of n and m shingles link, by their sorted shared shingles a and b. Suffix filter
    first: both are cut at the same pivots, and the smaller of each pair of parts bounds what they
    have in common there."""
    need = overlap_needed(n, m, percent)
    if min(len(a), len(b)) < need:
        return False
    pivots = a[:: max(1, len(a) // 8)]
    parts = [np.diff(np.concatenate([[0], np.searchsorted(x, pivots), [len(x)]])) for x in (a, b)]
    if np.minimum(*parts).sum() < need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(ordered)))


def _read(column: pa.Array, i: int, kind: str) -> np.ndarray:
    value = column[i].as_buffer()
    return np.frombuffer(value, kind) if value is not None else np.zeros(0, kind)


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


# A message of a chunk: to a bucket (document numbers and shingles that the chunk has once; those it
# has more often and how often), the answer (with counts), or its own documents with the shingles that
# it has more often (`who`), the number of buckets that answer.
_MESSAGE = "bucket int, chunk binary, own binary, tokens binary, counts binary, many binary, sums binary, asked int, doc_ids array<long>, ths array<long>, sizes array<int>, nodes array<binary>"
_MESSAGE_ARROW = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.binary())] + [(n, pa.binary()) for n in ("own", "tokens", "counts", "many", "sums")]
    + [("asked", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("nodes", pa.list_(pa.binary()))]
)


class _Chunk:
    """Documents of a task until they are sent."""

    def __init__(self):
        self.doc_ids, self.ths, self.sizes, self.nodes, self.sets, self.met, self.held = [], [], [], [], [], set(), 0

    def add(self, doc_id: int | None, th: int, own: np.ndarray) -> None:
        node = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
        again = node is None or node in self.met
        self.met.add(node)
        for x, v in zip((self.doc_ids, self.ths, self.sizes, self.nodes, self.sets), (doc_id, th, len(own), node, own[:0] if again else own), strict=True):
            x.append(v)
        self.held += len(self.sets[-1])

    def messages(self, buckets: int) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, _U)
        own = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets]).astype("<u2")
        order = np.argsort(tokens, kind="stable")
        tokens, own = tokens[order], own[order]
        starts, size = _runs(tokens)
        once = np.repeat(size == 1, size)
        name = xxhash.xxh3_128_digest(b"%d" % TaskContext.get().partitionId() + b"".join(n or b"" for n in self.nodes) + np.array(self.ths, np.int64).tobytes())
        many, sums = tokens[starts[size > 1]], size[size > 1].astype("<u4")
        # sorted shingles lie in the order of buckets
        edges = (np.arange(1, buckets, dtype=np.int64) << 32) // buckets
        edges = edges.astype(_U) << _U(32)
        cut = lambda x: np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]).tolist()
        a, b = tokens[once], own[once]
        at, at_many, asked = cut(a), cut(many), 0
        rows = []
        for k in range(buckets):
            s, t = slice(at[k], at[k + 1]), slice(at_many[k], at_many[k + 1])
            if s.stop > s.start or t.stop > t.start:
                rows.append({"bucket": k, "chunk": name, "own": b[s].tobytes(), "tokens": a[s].tobytes(), "many": many[t].tobytes(), "sums": sums[t].tobytes()})
                asked += 1
        who = {"doc_ids": self.doc_ids, "ths": self.ths, "sizes": self.sizes, "nodes": self.nodes}
        yield _batch(_MESSAGE_ARROW, [*rows, {"bucket": name[0] % buckets, "chunk": name, "own": own[~once].tobytes(), "tokens": tokens[~once].tobytes(), "asked": asked, **who}])


def _cut(docs: DataFrame, buckets: int) -> DataFrame:
    """The messages of all chunks of docs (doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in small_batches(batches, limit=STEP):
            words = Words(batch, lower=True)
            rolled = shingle_hashes(words.hash, K)
            spans = zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)
            for doc_id, th, (a, b) in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), spans, strict=True):
                chunk.add(doc_id, th, shingle_set(words.hash[a:b], rolled[a : max(a, b - K + 1)]))
                if chunk.held >= CHUNK or len(chunk.sets) == MOST_DOCS:
                    yield from chunk.messages(buckets)
                    chunk = _Chunk()
        if chunk.sets:
            yield from chunk.messages(buckets)

    return docs.mapInArrow(lean(run), _MESSAGE)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages ordered by bucket -> how many documents have each shingle, for those that two have."""

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([x for r in rows for x in (r[2], r[3])])
        n = np.concatenate([x for r in rows for x in (np.ones(len(r[2]), np.int64), r[4].astype(np.int64))])
        order = np.argsort(tokens)
        starts, size = _runs(tokens[order])
        total = np.add.reduceat(n[order], starts) if len(starts) else n
        n[order] = np.repeat(total, size)
        at, out = 0, []
        for chunk, own, single, many, _ in rows:
            one, more = n[at : at + len(single)], n[at + len(single) : at + len(single) + len(many)]
            at += len(single) + len(many)
            yes = one > 1
            out.append({"chunk": chunk, "own": own[yes].tobytes(), "tokens": single[yes].tobytes(), "counts": one[yes].astype("<u4").tobytes(), "many": many.tobytes(), "sums": more.astype("<u4").tobytes()})
            if len(out) == 64:
                yield _batch(_MESSAGE_ARROW, out)
                out = []
        yield _batch(_MESSAGE_ARROW, out)

    rows, bucket = [], None
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        asked = col["asked"].is_valid()
        if asked.true_count:
            yield batch.filter(asked)
        numbers = col["bucket"].to_numpy()
        for i in np.flatnonzero(~asked.to_numpy(zero_copy_only=False)).tolist():
            if numbers[i] != bucket:
                if rows:
                    yield from answer(rows)
                rows, bucket = [], numbers[i]
            rows.append((col["chunk"][i].as_py(), _read(col["own"], i, "<u2"), _read(col["tokens"], i, "<u8"), _read(col["many"], i, "<u8"), _read(col["sums"], i, "<u4")))
    if rows:
        yield from answer(rows)


_RANKED = "doc_id long, th long, n_shingles long, node binary, shared binary, prefix array<long>, score long"
_RANKED_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64())), ("score", pa.int64())])


def _ranked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Messages ordered by chunk -> its documents; those of which enough shingles are shared with
    their shared shingles, the shared part of their prefix, rarest first, and the sum of its counts."""

    def documents(who: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if who is None or len(rows) != who["asked"]:
            raise RuntimeError("documents were read in another order than before: write them first")
        many, sums = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, _U) for k in (3, 4))
        order = np.argsort(many)
        place = np.searchsorted(many[order], who["tokens"])
        own = np.concatenate([*(r[0] for r in rows), who["own"]])
        tokens = np.concatenate([*(r[1] for r in rows), who["tokens"]])
        counts = np.concatenate([*(r[2] for r in rows), sums[order][place]]) if len(tokens) else np.zeros(0, np.uint32)
        order = np.lexsort((tokens, counts, own))
        tokens, counts = tokens[order], counts[order]
        ends = np.searchsorted(own[order], np.arange(len(who["sizes"])), "right").tolist()
        out = []
        for d, (begin, end, n) in enumerate(zip([0, *ends], ends, who["sizes"])):
            row = {"doc_id": who["doc_ids"][d], "th": who["ths"][d], "n_shingles": n, "node": who["nodes"][d]}
            more = end - begin - needed(n, percent) + 1
            if n and more > 0:
                prefix = slice(begin, begin + more)
                row |= {"shared": np.sort(tokens[begin:end]).tobytes(), "prefix": tokens[prefix].view(np.int64), "score": int(counts[prefix].sum())}
            out.append(row)
            if len(out) == 4096:
                yield _batch(_RANKED_ARROW, out)
                out = []
        yield _batch(_RANKED_ARROW, out)

    chunk, who, rows = None, None, []
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        names, asked = col["chunk"].to_pylist(), col["asked"].to_pylist()
        for i, name in enumerate(names):
            if name != chunk:
                if chunk is not None:
                    yield from documents(who, rows)
                chunk, who, rows = name, None, []
            if asked[i] is None:
                rows.append((_read(col["own"], i, "<u2"), _read(col["tokens"], i, "<u8"), _read(col["counts"], i, "<u4"), _read(col["many"], i, "<u8"), _read(col["sums"], i, "<u4")))
            else:
                who = {n: col[n][i].as_py() for n in ("doc_ids", "ths", "sizes", "nodes", "asked")} | {"own": _read(col["own"], i, "<u2"), "tokens": _read(col["tokens"], i, "<u8")}
    if chunk is not None:
        yield from documents(who, rows)


def ranked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row a document: doc_id, th (hash of the text), n_shingles, node (its class); shared (sorted
    shared shingles), prefix (its shared part, rarest first) and score, where enough are shared."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET + 1)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    sums = _cut(rows, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_answers), _MESSAGE)
    return sums.repartition(buckets, "chunk").sortWithinPartitions("chunk").mapInArrow(lean(lambda batches: _ranked(batches, percent)), _RANKED)


def _meeting(left: str, right: str, percent: int) -> F.Column:
    """Length and positional filter: what stands from the shared shingle on must be enough."""
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    rest = F.least(n - F.col(f"{left}pos"), m - F.col(f"{right}pos"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= percent * (n + m))


def verified(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) of classes that link."""
    left = classes.select(F.col("cls").alias("x"), F.col("n").alias("_n"), F.col("shared").alias("_a"))
    right = classes.select(F.col("cls").alias("y"), F.col("n").alias("_m"), F.col("shared").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(k) for k in ("_a", "_b", "_n", "_m"))
            yes = [linked(_read(a, i, "<u8"), _read(b, i, "<u8"), n[i].as_py(), m[i].as_py(), percent) for i in range(batch.num_rows)]
            yield batch.select(["x", "y"]).filter(pa.array(yes, pa.bool_()))

    return pairs.join(left, "x").join(right, "y").select("x", "y", "_n", "_m", "_a", "_b").mapInArrow(lean(run), "x long, y long")


def _lists(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, cls, pos, n, score) of prefix shingles that several classes have."""
    unshared = F.col("n") - F.octet_length("shared") / 8
    posts = classes.select("cls", "n", "score", unshared.cast("long").alias("skip"), F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("skip")).drop("skip")
    several = posts.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("token")
    return scratch.keep(posts.join(scratch.keep(several, "several"), "token", "left_semi"), "lists")


def _open(posts: DataFrame, roots: DataFrame | None, percent: int, scratch: Scratch) -> DataFrame:
    """posts with lab, the component of a class: lists that hold several, less what the length and
    positional filter rules out whatever it meets: the shortest class and the earliest place of a
    list bound what any other can do."""
    if roots is None:
        posts = posts.withColumn("lab", F.col("cls"))
    else:
        posts = scratch.keep(posts.drop("lab").join(roots.withColumnRenamed("key", "cls"), "cls", "left").withColumn("lab", F.coalesce("root", "cls")).drop("root"), "labelled")
    rest = F.col("n") - F.col("pos")
    state = posts.groupBy("token").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.min("n").alias("least"), F.max(rest).alias("reach")).where("lo < hi").drop("lo", "hi")
    shortest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    near = posts.join(scratch.keep(state, "state"), "token").where(F.least(rest, F.col("reach")) * (100 + percent) >= percent * (F.col("n") + shortest))
    return scratch.keep(near.drop("least", "reach"), "open")


def _hub_pairs(posts: DataFrame, hubs_each: int, turn: int, percent: int, scratch: Scratch) -> DataFrame:
    """(x, y): each class of a list with `hubs_each` hubs of it."""
    salt = F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(hubs_each))
    best = F.max(F.struct("score", "cls", "pos", "n", "lab")).alias("h")
    hubs = posts.groupBy("token", salt.alias("s")).agg(best).select("token", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("cls", "pos", "n", "lab")))
    met = posts.join(scratch.keep(hubs, "hubs"), "token").where((F.col("lab") != F.col("h_lab")) & _meeting("", "h_", percent))
    return met.select(F.least("cls", "h_cls").alias("x"), F.greatest("cls", "h_cls").alias("y")).distinct()


def _rest_pairs(posts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(x, y): what is outside the largest component of a list with all others of the list."""
    by_label = posts.groupBy("token", "lab").agg(F.count("*").alias("c"))
    largest = by_label.groupBy("token").agg(F.max(F.struct("c", "lab")).alias("m")).select("token", F.col("m.lab").alias("main"))
    small = posts.join(scratch.keep(largest, "largest"), "token").where("lab <> main")
    small = scratch.keep(small.select("token", *(F.col(c).alias(f"h_{c}") for c in ("cls", "pos", "n", "lab"))), "outside")
    met = posts.join(small, "token").where((F.col("lab") != F.col("h_lab")) & _meeting("", "h_", percent))
    return met.select(F.least("cls", "h_cls").alias("x"), F.greatest("cls", "h_cls").alias("y")).distinct()


def links_of(posts: DataFrame, classes: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame | None:
    """(key, root): the component of each linked class; none without links."""
    links, roots, done, turn, hubs_each = None, None, None, 0, 1
    while True:
        posts = _open(posts, roots, percent, scratch)
        if posts.isEmpty():
            return roots
        last = turn > 0 and found.isEmpty()
        pairs = _rest_pairs(posts, percent, scratch) if last else _hub_pairs(posts, hubs_each, turn, percent, scratch)
        pairs = scratch.keep(pairs if done is None else pairs.join(done, ["x", "y"], "left_anti"), f"pairs-{turn}")
        done = pairs if done is None else done.unionByName(pairs)
        found = scratch.keep(verified(pairs, classes, percent), f"links-{turn}")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = components(links, scratch)
        if last:
            return roots
        turn, hubs_each = turn + 1, hubs_each * GROWTH


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, root) of all ends of links (x, y): root is the smallest key that can be reached."""
    both = scratch.keep(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "both")
    labels = scratch.keep(both.groupBy(F.col("x").alias("key")).agg(F.min("y").alias("r")).select("key", F.least("key", "r").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("key", "y"), "y").groupBy(F.col("x").alias("key")).agg(F.min("root").alias("near"))
        step = labels.join(near, "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("far"))
        new = scratch.keep(step.join(jump, "root", "left").select("key", "old", F.least("root", "far").alias("root")), "labels")
        labels = new.select("key", "root")
        if new.where("old <> root").isEmpty():
            return labels


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row a document: doc_id, th (hash of the text), n_shingles, component_id, and group, which
    names its component: component_id can be null or stand for several, as ids can repeat. Documents
    without words have no group."""
    spark = docs.sparkSession
    with freed_shuffles(spark), Scratch(spark, "shingles") as scratch:
        people = scratch.keep(ranked(docs, percent), "members")
        scratch.tasks = max(LEAST_TASKS, people.count() // TASK_DOCS)
        some = people.where(F.col("shared").isNotNull()).dropDuplicates(["node"])
        classes = scratch.keep(some.select(F.monotonically_increasing_id().alias("cls"), "node", F.col("n_shingles").alias("n"), "score", "prefix", "shared"), "classes")
        roots = links_of(_lists(classes, scratch), classes, scratch, percent)
        base = people.select("doc_id", "th", "n_shingles", "node")
        names = base.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("lowest"))
        if roots is None:
            groups = names.select("node", F.col("lowest").alias("component_id"), F.col("node").alias("group"))
        else:
            ids = scratch.keep(classes.select("cls", "node").join(roots.withColumnRenamed("key", "cls"), "cls").select("node", "root"), "roots")
            whole = scratch.keep(names.join(ids, "node", "left").withColumn("group", F.coalesce(F.unhex(F.lpad(F.hex("root"), 16, "0")), "node")), "named")
            lowest = whole.groupBy("group").agg(F.min("lowest").alias("component_id"))
            groups = whole.join(scratch.keep(lowest, "lowest"), "group").select("node", "component_id", "group")
        out = base.join(scratch.keep(groups, "groups"), "node", "left")
        return scratch.give(out.select("doc_id", "th", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group"))


def similarity_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) with n_shingles and component_id."""
    return attach(docs, grouped(docs, percent).drop("group").distinct(), ["n_shingles", "component_id"])


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs less all but one document of each group: the one with the smallest doc_id, then the
    smallest hash of its text. Documents without words stay; of rows equal in id and text one does."""
    groups = grouped(docs, percent)
    first = groups.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")).alias("r")).select("r.doc_id", "r.th")
    chosen = first.unionByName(groups.where("n_shingles = 0").select("doc_id", "th").distinct())
    repeated = not groups.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return attach(docs, chosen, [], once=repeated)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grouped(docs).select("doc_id", "n_shingles", "component_id")
