"""Draw documents that look like a target set: importance resampling over hashed words and word pairs.

A byte automaton reads whole Arrow batches: a table classifies every byte of the UTF-8 buffer, differences of the classes give where
words begin and end, and the CRC-32 of all words advance together, one byte a step, by the usual table of 256 entries. A pair's
CRC goes on from the state of its first word, so pairs are never put together. Texts are never decoded.

Two passes read the documents: one adds up the counts of the buckets, which are a fixed number of sums, the other weighs each
document by the gains of its buckets. Ranks come from the counts of the scores, so no task sees all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, stored, table
from tidemark.llm.hashing import LOWER

#: Bytes of words: digits, a-z (after A-Z went to lower case) and all of characters beyond ASCII.
_INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Longer words go to zlib one by one, as steps over a few words do not pay.
LONG = 128
_SPACE = 32


def _crc_table() -> np.ndarray:
    """The states of CRC-32 (reflected polynomial EDB88320) after each byte, from state 0."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, A-Z in lower case, and where each text begins in them, with the end last. Null is an empty text."""
    binary = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, 8 * binary.offset)
    data = binary.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return LOWER[np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of each word; no word goes from one text to the next."""
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    padded = np.concatenate([[False], inside, [False]])
    begins = np.flatnonzero(inside & (~padded[:-2] | edge[:-1]))
    stops = np.flatnonzero(inside & (~padded[2:] | edge[1:])) + 1
    return begins, stops, np.searchsorted(offsets, begins, side="right") - 1


def advanced(state: np.ndarray, data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of each word, all words a byte further at each step."""
    sizes = stops - begins
    order = np.argsort(-sizes, kind="stable")
    now, at, falling = state[order], begins[order], -sizes[order]
    first = int(np.searchsorted(falling, -LONG, side="left"))  # words before are longer than LONG
    for i in range(first):
        whole = memoryview(data[at[i] : at[i] - falling[i]])
        now[i] = zlib.crc32(whole, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for step in range(int(-falling[first]) if first < len(now) else 0):
        last = int(np.searchsorted(falling, -step, side="left"))  # words that have a byte here
        one = now[first:last]
        now[first:last] = _CRC[(one ^ data[at[first:last] + step]) & 0xFF] ^ (one >> 8)
    out = np.empty_like(now)
    out[order] = now
    return out


def features(column: pa.Array, buckets: int, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each feature, by word and then by pair of words, and the number of words of each text."""
    data, offsets = buffer(column)
    begins, stops, text = words(data, offsets)
    state = advanced(np.full(len(begins), 0xFFFFFFFF, np.uint32), data, begins, stops)
    crc, of = [~state], [text]
    if pairs:
        together = np.flatnonzero(text[1:] == text[:-1])
        before = state[together]
        before = _CRC[(before ^ _SPACE) & 0xFF] ^ (before >> 8)
        crc.append(~advanced(before, data, begins[together + 1], stops[together + 1]))
        of.append(text[together])
    return (np.concatenate(crc) % np.uint32(buckets)).astype(np.int64), np.concatenate(of), np.bincount(text, minlength=len(column))


def bucket_counts(texts: DataFrame, buckets: int = 10_000, pairs: bool = True) -> DataFrame:
    """bucket and n, the number of features in it over all rows of texts (text); buckets without features have no row.

    A task adds up all it reads and gives a row for each bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in sliced(batch):
                total += np.bincount(features(part["text"], buckets, pairs)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, docs: DataFrame, buckets: int = 10_000, pairs: bool = True) -> np.ndarray:
    """What a feature of each bucket speaks for the target, in thousandths of a natural logarithm, rounded down. The driver reads a
    row for each bucket at most."""
    rows = bucket_counts(docs, buckets, pairs).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, buckets, pairs).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), np.float64)
    for r in rows.collect():
        counts[r["side"], r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, pairs: bool = True) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain of the features, 0 without any) of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                bucket, text, n_words = features(part["text"], len(sent.value), pairs)
                n = np.bincount(text, minlength=len(n_words))
                total = np.bincount(text, sent.value[bucket], len(n_words)).astype(np.int64)  # sums of whole numbers, exact in doubles
                columns = [part["doc_id"], pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, pairs: bool = True, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of docs (doc_id, text), drawn to look like target (text).

    score is the weight and a Gumbel variate that doc_id and seed fix, so that the highest scores are a draw without replacement by
    importance, and reruns agree. rank counts the drawn ones from 1: floor(percent * N / 100) of the N rows with least_words
    words, highest scores first, ties to the smaller doc_id, null last; others have no rank. Null and empty texts have
    no features and weight 0; rows that share a doc_id are documents of their own. An empty target has gains of the smoothing alone.
    Other columns are left out. No rows: no rows.

    The ranks of a score begin after the counts of all higher scores. Scores are whole thousandths within some tens of
    thousands, whatever the number of documents, and noise spreads the documents over them.
    """
    rows = weighed(docs, gains(target, docs, buckets, pairs), pairs)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    rows = stored(rows.withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    able = F.col("n_words") >= least_words
    counts = rows.where(able).groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("score"))) - F.col("n")
    counts = counts.select(F.col("score").alias("at"), above.alias("above"), F.floor(F.sum("n").over(W.partitionBy()) * percent / 100).alias("drawn"))
    placed = rows.where(able).join(counts, F.col("score") == F.col("at"))
    rank = F.col("above") + F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    reached = placed.where("above < drawn").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    none = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    out = reached.select(*columns, F.col("rank").cast("long").alias("rank"))
    return out.unionByName(placed.where("above >= drawn").select(*columns, none)).unionByName(rows.where(~able).select(*columns, none))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that resample draws, whole. docs is keyed by doc_id: all rows with a drawn doc_id stay."""
    got = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(got, F.col("doc_id").eqNullSafe(F.col("__drawn")), "left_semi")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
