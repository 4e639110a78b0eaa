"""Language of whole texts by averaged subword embeddings.

Runs of two to four bytes inside words, with the spaces around them, are hashed into buckets; each bucket has a small vector, a text is
the mean of the vectors of all its runs, and a linear softmax over languages reads it. Vectors and softmax are learned together by
stochastic gradient descent in numpy. What the softmax says of held-out rows of the sample is then calibrated: the margin
between languages counts for more in a long text, by two numbers fitted on these rows, and the least calibrated probability at
which the wanted share of them is right is the bar below which a text is marked as rejected.

The mean of vectors and the softmax are linear, so a bucket's vector times the softmax's weights is one row of scores a language;
that table, of fixed size, is all that goes to the tasks that read the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, stored, table

#: Rows that the model learns from, shared evenly by the languages: those with the least hashes.
FIT = 3000
#: Languages with the most rows that take part.
LANGUAGES = 250
BUCKETS, WIDTH = 1 << 14, 16
ORDERS = (2, 3, 4)
#: Every so many-th row of the sample calibrates and does not train.
HELD = 5
EPOCHS, BATCH, RATE = 12, 32, 40.0
#: Share of held-out rows above the bar that have to be right.
WANTED = 0.99

_MIX = np.uint32(0x01000193)
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
#: Bytes of words; all others are a space.
_WORD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each run of bytes that has a space at its ends at most, of texts in lower case."""
    texts = pc.utf8_lower(pc.fill_null(column, ""))
    joined = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(" "), pa.scalar("")).cast(pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset)
    data = _WORD[np.frombuffer(joined.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))]
    text = np.repeat(np.arange(len(joined), dtype=np.int32), np.diff(offsets))
    letter = data != 32
    running, inner = data.astype(np.uint32), np.ones(len(data), bool)
    bucket, of = [], []
    for order in range(2, max(ORDERS) + 1):
        running = (running[:-1] * _MIX) ^ (data[order - 1 :] * np.uint32(0x9E3779B1))
        inner = inner[:-1] & letter[order - 2 : -1] if order > 2 else inner[:-1]
        if order in ORDERS:
            some = letter[:-1] | letter[1:] if order == 2 else inner
            good = some & inner & (text[: len(running)] == text[order - 1 :])
            mixed = running[good] * np.uint32(0x85EBCA6B) + np.uint32(order)
            bucket.append(((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int32))
            of.append(text[: len(running)][good])
    return np.concatenate(bucket), np.concatenate(of)


def lettered(column: pa.Array) -> np.ndarray:
    """Which texts have a letter of any script."""
    out = np.zeros(len(column), bool)
    for i, t in enumerate(column.to_pylist()):
        out[i] = t is not None and _LETTER.search(t) is not None
    return out


@dataclass
class Model:
    """Scores of each bucket and language, the languages' names, two numbers of the calibration and the bar."""

    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    scale: tuple[float, float]
    bar: float

    def probabilities(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        logits = (mean + self.bias) * np.exp(self.scale[0] + self.scale[1] * np.log1p(n))[:, None]
        return _softmax(logits)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dense(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of shares of the buckets for each bag (buckets and counts)."""
    x = np.zeros((len(bags), BUCKETS), np.float32)
    for i, (bucket, n) in enumerate(bags):
        x[i, bucket] = n / n.sum()
    return x


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, softmax weights and bias, by stochastic gradient descent with a falling rate over shuffled rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, languages), np.float32), np.zeros(languages, np.float32)
    steps, step = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = _dense([bags[i] for i in rows])
            hidden = x @ vectors
            miss = _softmax(hidden @ weights + bias)
            miss[np.arange(len(rows)), labels[rows]] -= 1
            miss *= RATE * (1 - step / steps) / len(rows)
            back = miss @ weights.T
            weights -= hidden.T @ miss
            bias -= miss.sum(axis=0) * 0.05
            vectors -= x.T @ back
            step += 1
    return vectors, weights, bias


def calibrated(logits: np.ndarray, n: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a and b such that exp(a + b * log(1 + n)) times the logits gives the held-out labels the most likelihood, by descent with halved
    steps; what is sure beyond a few thousandths gains nothing, so scores stay within 0 and 1."""
    length = np.log1p(n)

    def loss(a: float, b: float) -> float:
        p = _softmax(logits * np.exp(np.clip(a + b * length, -10, 6))[:, None])[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-9)).mean() + 1e-3 * (a * a + b * b))

    a = b = 0.0
    best, step = loss(a, b), 1.0
    while step > 1e-3:
        tried = min((loss(a + x * step, b + y * step * 0.3), a + x * step, b + y * step * 0.3) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)))
        if tried[0] < best - 1e-9:
            best, a, b = tried
        else:
            step /= 2
    return a, b


def bar(score: np.ndarray, right: np.ndarray, wanted: float = WANTED) -> float:
    """The least score such that the wanted share of the rows at or above it is right; 1 where none is."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    score = score[order]
    last = np.flatnonzero((share >= wanted) & (np.append(score[1:], -1.0) < score))  # equal scores stand together
    return float(score[last[-1]]) if len(last) else 1.0


def sampled(docs: DataFrame, fit: int = FIT) -> DataFrame:
    """lang, bucket and n (arrays) of the whole texts of at most fit rows of docs (doc_id, text, lang), as many of each language: those
    with the least hashes. The sample is cut by rates first, so no task sorts a language's rows."""
    rows = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").withColumn("u", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES), "languages")
    each = max(1, fit // max(1, counts.count()))
    rate = (F.lit(each) + 5 * F.sqrt(F.lit(float(each))) + 5) / F.col("n")
    few = rows.join(counts, "lang").where(F.col("u") < rate)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("u", "doc_id"))
    few = few.select("lang", "text", nth.alias("nth"), F.col("u")).where(F.col("nth") <= each)

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                bucket, text = grams(part["text"])
                pair, n = np.unique(text.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                ends = np.searchsorted(pair, np.arange(1, len(part) + 1) * BUCKETS)
                bags = [(pair[a:b] % BUCKETS, n[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                columns = [part["lang"], part["nth"], pa.array([b.astype("<u2").tobytes() for b, _ in bags], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in bags], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "nth", "bucket", "n"])

    return few.select("lang", "text", "nth").mapInArrow(bagged, "lang string, nth int, bucket binary, n binary").where(F.length("bucket") > 0)


def fitted(docs: DataFrame, fit: int = FIT, seed: int = 3) -> Model | None:
    """The model of a sample of docs (doc_id, text, lang); None where no row has a language and a letter. The driver holds fit rows of
    at most BUCKETS counts."""
    rows = sorted(sampled(docs, fit).collect(), key=lambda r: (r["nth"], r["lang"]))
    if not rows:
        return None
    names = sorted({r["lang"] for r in rows})
    bags = [(np.frombuffer(r["bucket"], "<u2"), np.frombuffer(r["n"], "<u4")) for r in rows]
    labels = np.array([names.index(r["lang"]) for r in rows])
    held = np.array([r["nth"] % HELD == 0 for r in rows])
    keep = np.flatnonzero(~held)
    vectors, weights, bias = train([bags[i] for i in keep], labels[keep], len(names), seed)
    model = Model(names, vectors @ weights, bias, (0.0, 0.0), 0.0)
    at = np.flatnonzero(held)
    if len(names) > 1 and len(at):
        mean = np.concatenate([_dense([bags[i] for i in at[k : k + 64]]) @ model.table for k in range(0, len(at), 64)])
        n = np.array([bags[i][1].sum() for i in at])
        model.scale = calibrated(mean + bias, n, labels[at])
        p = model.probabilities(mean, n)
        model.bar = bar(p.max(axis=1), p.argmax(axis=1) == labels[at])
    return model


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row of docs (doc_id, text) by the whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times LANGUAGES numbers at most
    names = ["doc_id", "lang_pred", "score", "rejected"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in sliced(batch):
                able = lettered(part["text"])
                if model is None:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(["und"] * len(part)), pa.array(np.zeros(len(part))), pa.array(np.ones(len(part), bool))], names)
                    continue
                bucket, text = grams(part["text"])
                n = np.bincount(text, minlength=len(part))
                mean = np.stack([np.bincount(text, model.table[:, k][bucket], len(part)) for k in range(len(model.names))], axis=1) / np.maximum(n, 1)[:, None]
                p = model.probabilities(mean, n)
                best, score = p.argmax(axis=1), np.where(able, p.max(axis=1), 0.0)
                named = pa.array(model.names, pa.string()).take(pa.array(best))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pc.if_else(pa.array(able), named, "und"), pa.array(score), pa.array(~able | (score < model.bar))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, fit: int = FIT, seed: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row of docs (doc_id, text, lang), learned from those of docs that are not
    held out: whose crc32(doc_id as text) mod 4 is not 2 (null doc_ids are not).

    lang_pred is a language of the sample, und where the text is null or has no letter (score 0, rejected); where no row can be learned
    from, it is und everywhere. score is the calibrated probability; rejected marks scores below the bar. A prediction depends on
    the text alone: repeated texts have equal ones. Equal scores go to the language that is first in code-point order. Other columns
    are left out. No rows: no rows.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fitted(docs.where(~out), fit, seed)
    return predicted(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
