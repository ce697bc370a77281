"""Language identification: words first, then ever shorter character n-grams.

Training counts, over labelled documents, how often each lower-case word (run of letters) stands in
each language, and how often each character n-gram of MAX_N to 1 letters stands in its words, with
the word's edges marked. Only counts and bounded lists enter the model: the WORDS most frequent words
and, for each n, the GRAMS most frequent n-grams, which occur MIN_COUNT times or more. Lists are
shorter if there are so many languages that the table would have more than CELLS entries.

A word of the list scores its log frequency in each language. An unseen word falls back to its
n-grams of MAX_N letters; if none of those is listed, to those one letter shorter, and so on; its
score is the mean over the n-grams of that length. A text's score for a language is the log of the
language's share of all training documents plus the sum over its words; the best language is
predicted, with its posterior as `score`.

At most about SAMPLE documents of each language are read for words (all, if there are fewer): those
with the smallest hash of doc_id; the languages' shares come from all. Equal texts of the sample
count once. Prediction covers every row and whole texts, and knows nothing but the text.

Defined cases: null, empty and letterless texts are `und` with score 0, as are all texts if nothing
can be learned; a text in which no word or n-gram is known gets the most frequent language; languages
that score the same are taken in alphabetical order; repeated rows get equal results; a very long
text is scored whole; further columns pass through, but those named like a result are replaced.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, widened

#: Bounds of training and model: documents a language, words, n-grams of each length.
SAMPLE, WORDS, GRAMS = 4_000, 60_000, 20_000
MAX_N, MIN_COUNT = 4, 2
#: Entries (words or n-grams times languages) of the model at most.
CELLS = 24 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document must not be learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame) -> DataFrame:
    """The documents to learn from."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def training_rows(docs: DataFrame, shares: dict[str, int], sample: int = SAMPLE) -> DataFrame:
    """(text, lang) of the sample. A document is taken if the hash of its id is under its language's
    share of the hash range that is expected to hold `sample` documents. shares: documents of each
    language, which the driver holds already; they are sent to all tasks."""
    scale = 1 << 30
    sizes = F.broadcast(docs.sparkSession.createDataFrame(sorted(shares.items()), "lang string, n long"))
    share = F.least(F.lit(scale), F.floor(F.lit(scale * sample) / F.col("n")))
    return labelled(docs).select("doc_id", "text", "lang").join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).select("text", "lang")


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: languages, their log shares, and log frequencies of words and n-grams."""
    shares = {r["lang"]: r["n"] for r in labelled(docs).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return {"langs": []}
    rows = training_rows(docs, shares, sample).where(F.col("text").isNotNull()).distinct()
    words = F.array_remove(F.split(F.lower(F.col("text")), r"[^\p{L}]+"), "")
    counted = rows.select("lang", F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).persist()
    try:
        part = min(1.0, CELLS / ((WORDS + MAX_N * GRAMS) * len(langs)))
        top_words = _logs(counted, "w", langs, int(WORDS * part))
        grams = {}
        for n in range(1, MAX_N + 1):
            found = counted.select("lang", "n", F.explode(_grams(F.col("w"), n)).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
            grams[n] = _logs(found, "g", langs, int(GRAMS * part))
    finally:
        counted.unpersist()
    prior = np.log(np.array([shares[x] for x in langs], float) / sum(shares.values()))
    return {"langs": langs, "prior": prior, "words": top_words, "grams": grams}


def _grams(word: Column, n: int) -> Column:
    """The n-grams of a word, null if it is too short; for n > 1 its edges are marked."""
    text = word if n == 1 else F.concat(F.lit("_"), word, F.lit("_"))
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def _logs(counted: DataFrame, key: str, langs: list[str], most: int) -> tuple[dict[str, int], np.ndarray]:
    """Of the `most` most frequent keys of counted (lang, key, n): their rows, and log frequencies by
    language, smoothed by half a count."""
    top = counted.groupBy(key).agg(F.sum("n").alias("t")).where(F.col("t") >= MIN_COUNT).orderBy(F.desc("t"), key).limit(most)
    found = counted.join(F.broadcast(top.select(key)), key).select(key, "lang", "n").toArrow()
    keys, langs_at = found.column(key).to_pylist(), {x: i for i, x in enumerate(langs)}
    row = {k: i for i, k in enumerate(sorted(set(keys)))}
    n = np.zeros((len(row), len(langs)))
    n[[row[k] for k in keys], [langs_at[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return row, np.log((n + 0.5) / (n.sum(0) + 0.5 * max(len(n), 1))).astype(np.float32)


class Predictor:
    """Scores texts by a model; remembers the scores of words it has met, up to `limit`."""

    def __init__(self, model: dict, limit: int = 400_000):
        import regex

        self.model = model
        self.letters = regex.compile(r"\p{L}+")
        self.row: dict[str, int] = {}
        self.limit = min(limit, CELLS // 8 // max(1, len(model["langs"])))
        self.scores = np.zeros((1024, len(model["langs"])))

    def word(self, w: str) -> np.ndarray:
        rows, logs = self.model["words"]
        if w in rows:
            return logs[rows[w]]
        for n in range(MAX_N, 0, -1):
            text, (rows, logs) = (w if n == 1 else f"_{w}_"), self.model["grams"][n]
            got = [rows[g] for g in (text[i : i + n] for i in range(len(text) - n + 1)) if g in rows]
            if got:
                return logs[got].mean(0, dtype=np.float64)
        return np.zeros(len(self.model["langs"]))

    def index(self, w: str) -> int:
        at = self.row.get(w)
        if at is None:
            at = self.row[w] = len(self.row)
            if at >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at] = self.word(w)
        return at

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs = self.model["langs"]
        if len(self.row) > self.limit:
            self.row.clear()
        names, scores = [], []
        for text in texts:
            words = self.letters.findall(text.lower()) if text and langs else []
            if not words:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            row = self.row
            at = [row[w] if w in row else self.index(w) for w in words]
            total = self.model["prior"] + self.scores[at].sum(0)
            best = int(np.argmax(total))
            names.append(langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


@functools.lru_cache(1)
def _predictor(packed: bytes) -> Predictor:
    return Predictor(pickle.loads(packed))


def identify(docs: DataFrame, model: dict, column: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")  # replaced
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(sent.value)
        for batch in small_batches(batches, column):
            names, scores = predict(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs, "lang_pred string, score double"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
