"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged over a document, softmax on top.

Trained by plain stochastic gradient descent in numpy on a bounded sample of labelled rows. As the model is linear
after the average, each feature's vector is projected on the softmax once, and a document's score is the mean of its
features' projections: one memo look-up a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import map_batches, utf8

#: Buckets of hashed features, length of their vectors, lengths of n-grams, passes over the sample, rows of the sample.
BUCKETS, SIZE, GRAMS, EPOCHS, SAMPLE_ROWS = 1 << 17, 8, (3, 4), 4, 6000
CUT = 0.7


def features(word: bytes) -> np.ndarray:
    """Buckets of the word and of its n-grams between boundary marks; a word is a run of anything but ASCII white space."""
    padded = b"<" + word + b">"
    grams = [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)]
    return np.array([xxhash.xxh3_64_intdigest(g) % BUCKETS for g in (b"\0" + word, *grams)], np.int64)


def train(rows: list[tuple[bytes, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(projection of each bucket on the log-odds of label 1, bias) from texts and labels."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5 / SIZE, 0.5 / SIZE, (BUCKETS, SIZE))
    weights, bias = np.zeros((2, SIZE)), np.zeros(2)
    memo: dict[bytes, np.ndarray] = {}
    bags = []
    for text, label in rows:
        words = text.split()
        for w in set(words).difference(memo):
            memo[w] = features(w)
        if words:
            ids, counts = np.unique(np.concatenate([memo[w] for w in words]), return_counts=True)
            bags.append((ids.astype(np.int32), (counts / counts.sum()).astype(np.float32), label))
        else:
            bags.append((np.empty(0, np.int32), np.empty(0, np.float32), label))
    memo.clear()
    steps = max(1, EPOCHS * len(bags))
    for step in range(EPOCHS * len(bags)):
        if step % len(bags) == 0:
            order = rng.permutation(len(bags))
        ids, share, label = bags[order[step % len(bags)]]
        rate = 0.5 * (1 - step / steps)
        doc = share @ vectors[ids]
        z = weights @ doc + bias
        p = np.exp(z - z.max())
        error = p / p.sum()
        error[label] -= 1
        vectors[ids] -= (rate * 20) * share[:, None] * (error @ weights)
        weights -= rate * np.outer(error, doc)
        bias -= 0.1 * rate * error
    return (vectors @ (weights[1] - weights[0])).astype(np.float64), float(bias[1] - bias[0])


class Scorer(dict):
    """Word to (sum of its features' projections, number of features); a bounded memo."""

    LIMIT = 200_000

    def __init__(self, projection: np.ndarray, bias: float) -> None:
        self.projection, self.bias = projection, bias

    def __missing__(self, word: bytes) -> tuple[float, int]:
        if len(self) >= self.LIMIT:
            self.clear()
        ids = features(word)
        value = self[word] = (float(self.projection[ids].sum()), len(ids))
        return value

    def score(self, text: bytes) -> float:
        words = text.split()
        mean = 0.0
        if words:
            got = np.array([self[w] for w in words])
            mean = got[:, 0].sum() / got[:, 1].sum()
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40))))


def held_out(id_column: str = "doc_id"):  # noqa: ANN201
    return F.crc32(F.col(id_column).cast("string")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts that aren't held out, the ones of the least hash."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` rows of two numbers
    return [((r.text or "").encode("utf-8", "surrogatepass"), r.quality) for r in got.orderBy("doc_id").select("text", "quality").collect()]


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    Null and empty texts score by the bias alone. Without any labelled row all score 0.5. A null id is not held out.
    Only the text is an input of a score. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(sample(texts, labels, rows)))
    made: dict[int, Scorer] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if 0 not in made:
            made[0] = Scorer(*model.value)
        scores = [made[0].score(t) for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = map_batches(texts, one, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
