"""Pack token ids into windows by minimum bin slack.

Documents are cut into full windows and a rest. The plan needs only how many rests there are of each length: for the
longest rest left, a bitset subset-sum over the other lengths finds the multiset that fills its window closest to
capacity, and the same filling is repeated for as many windows as the counts allow. Pieces then find their window by
their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, stored, table
from tidemark.llm.tokens import VOCABULARY, encoder

#: Pieces that are ranked together, on average.
RANK_ROWS = 20_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of lengths with counts, the multiset whose sum is the largest up to capacity, as length to count.

    Bit s of reach tells that sum s can be made. Counts enter as 1, 2, 4, ... copies; what reach was before each step
    is kept, so that the choice is read back from the last step to the first.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            n = min(copies, left)
            steps.append((length, n, reach))
            reach |= reach << n * length & mask
            left -= n
            copies *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + n
            total -= n * length
    return chosen


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings (length to count) and the number of windows that each fills; together they use every piece.

    Each filling uses up the longest length or one of its partners, so fillings are bounded by the capacity, not by the pieces.
    """
    left, plan = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        others = left | {longest: left[longest] - 1}
        filling = fullest(others, capacity - longest)
        filling[longest] = filling.get(longest, 0) + 1
        windows = min(left[k] // n for k, n in filling.items())
        plan.append((filling, windows))
        for k, n in filling.items():
            left[k] -= n * windows
            if not left[k]:
                del left[k]
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks end, pieces a window, first window, offset of the first piece) of each filling and length."""
    used, window, out = {}, 0, []
    for filling, windows in plan:
        offset = 0
        for length, n in sorted(filling.items(), reverse=True):
            rank = used.get(length, 0)
            out.append((length, rank, rank + n * windows, n, window, offset))
            used[length] = rank + n * windows
            offset += n * length
        window += windows
    return out


def pieces(docs: DataFrame, capacity: int = 1024, vocabulary: str = VOCABULARY, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian unsigned 32-bit) of each piece."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            for part in sliced(batch):
                ids, ends = code.encoded(part["text"].to_pylist(), end)
                sizes = np.diff(ends, prepend=0)
                counts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), counts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
                begin = (ends - sizes)[doc] + start
                stop = np.minimum(begin + capacity, ends[doc])
                view = memoryview(ids.astype("<u4")).cast("B")
                bounds = [*zip((4 * begin).tolist(), (4 * stop).tolist(), strict=True)]
                columns = [part["doc_id"].take(pa.array(doc)), start, stop - begin, np.array([zlib.crc32(view[a:b]) for a, b in bounds], np.int64), sizes[doc]]
                if keep_ids:
                    columns.append(pa.array([bytes(view[a:b]) for a, b in bounds], pa.binary()))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names + ["ids"] * keep_ids)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, kind + ", ids binary" * keep_ids)


def pack(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """The pieces of all docs (doc_id, text) with sequence_id and offset.

    Each document is its ids and an end id; each id lies in one piece, and the pieces of a sequence follow each other from
    offset 0 without gaps. Null and empty texts: the end id alone. Rows that share a doc_id are documents of their own;
    equal pieces rank in any order. Null doc_ids stay null. Other columns are left out. No rows: no rows.
    The driver and the broadcast see the plan, whose size depends on capacity alone.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, **options), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(_slots(plan_windows(counts, capacity)), "length long, rank_from long, rank_to long, per_window long, first_window long, first_offset long")
    salts = max(8, -(-max(counts.values(), default=0) // RANK_ROWS))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sums = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    sums = sums.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.join(sums, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).drop(slots["length"])
    nth = F.col("rank") - F.col("rank_from")
    placed = placed.withColumn("sequence_id", F.col("first_window") + F.floor(nth / F.col("per_window")).cast("long"))
    placed = placed.withColumn("offset", F.col("first_offset") + F.pmod(nth, F.col("per_window")) * F.col("length"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*kept, *(["ids"] if "ids" in placed.columns else []))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
