"""Nearest neighbours by block matrix join.

Vectors are packed into blocks of rows. Each pair of a query block and a candidate block is one tile, and no block is shuffled
for it: a task reads a strip of candidate blocks from the shared folder and holds one query block after the other against it.
The product of int8 codes gives every inner product up to a known error, pairs that the bounds rule out go, the rest are
computed again from the original vectors in double precision, and short lists of each query are merged by sorting.

Candidates come in shares that grow eightfold, the smallest first, dealt out by a hash of their ids. What a query's k-th found so
far scores is its floor in the next share, so a share adds about 8 * k candidates a query, however large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemark.llm.common import stored, table

BLOCK = 4096
#: A share of the candidates holds so many times as many as all before it, and the first one so many blocks at most.
STEP, FIRST = 8, 16
#: Blocks of a file, as a reader holds many rows of a file at once.
FILE = 16
#: Numbers of originals that are multiplied at once.
AT_ONCE = 1_000_000


def _usable(vector: Column, dims: int) -> Column:
    clean = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dims) & clean & F.exists(vector, lambda x: x != 0)


def coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and a bound on the length of each row's rounding error."""
    scale = np.abs(rows).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    error = np.sqrt(((rows - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return codes, scale, error


def _ranked(at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs by query, the larger product first, then the smaller id, and the place of each in its query's list."""
    order = np.lexsort((ids, -scores, at))
    at = at[order]
    return at, ids[order], scores[order], np.arange(len(at)) - np.searchsorted(at, at)


class Lists:
    """The k nearest so far of each query of a block: larger product, then smaller id; never its own id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, floor_ids: np.ndarray, k: int):
        """floors, floor_ids: score and id of the k-th that is known of elsewhere; what is not nearer is not wanted. -inf: none is known."""
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.floors, self.floor_ids = floors.copy(), floor_ids.copy()
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        codes, scale, error = coded(queries)
        self.codes, self.scale, self.error = codes.astype(np.float32), scale, error / scale
        self.length = np.sqrt((queries**2).sum(axis=1)) / scale + self.error

    def _begin(self, rows: np.ndarray, ids: np.ndarray) -> None:
        """Floors for queries without one, from the first rows' products less what rounding may add."""
        new, n = np.flatnonzero(np.isneginf(self.floors)), min(len(ids), max(1024, 2 * self.k))
        if not len(new) or n < self.k:
            return
        queries = self.queries[new]
        low = queries @ rows[:n].T
        low -= 1e-12 * len(queries[0]) * np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((rows[:n] ** 2).sum(axis=1))[None, :]
        low[self.query_ids[new, None] == ids[None, :n]] = -np.inf
        self.floors[new] = np.nan_to_num(np.partition(low, n - self.k, axis=1)[:, n - self.k], nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
        self.floor_ids[new] = np.iinfo(np.int64).max

    def _alive(self, rows: np.ndarray) -> np.ndarray:
        """Which pairs may reach the floor.

        q.r = (q' + e).(r' + f) for codes q', r' and errors e, f, so |q.r - q'.r'| <= |q'||f| + |e||r'| + |e||f|. Product, bounds and floor are
        one product of longer vectors, in units of both scales, with what single precision may lose added to each term. A row whose
        scale is nothing beside the block's, and any sum that is no number, stays.
        """
        codes, scale, error = coded(rows)
        top, error = scale.max(), error / scale
        length = np.sqrt((rows**2).sum(axis=1)) / scale + error
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            floor = np.clip(self.floors / self.scale / top, -1e30, 1e30)
            lost = 1.2e-7 * (codes.shape[1] + 8)
            left = np.column_stack([self.codes, lost * abs(floor) - floor, *((1 + lost) * x for x in (self.length, self.error, self.error)), lost * np.sqrt((self.codes**2).sum(axis=1))])
            right = np.column_stack([codes, top / scale, error, length, error, np.sqrt((codes.astype(np.float32) ** 2).sum(axis=1))])
            left, right = left.astype(np.float32), right.astype(np.float32)
            right[scale < 1e-20 * top] = 0
            return ~(left @ right.T < 0)

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        self._begin(rows, ids)
        at, row = np.divmod(np.flatnonzero(self._alive(rows)), len(ids))
        other = self.query_ids[at] != ids[row]
        at, row = at[other], row[other]
        size = max(1, AT_ONCE // rows.shape[1])
        for i in range(0, len(at), size):
            a, r = at[i : i + size], row[i : i + size]
            scores = (self.queries[a] * rows[r]).sum(axis=1)
            near = (scores > self.floors[a]) | (scores == self.floors[a]) & (ids[r] <= self.floor_ids[a])
            self.more.append((a[near], ids[r[near]], scores[near]))
            if 2 * sum(len(x[0]) for x in self.more) > self.k * len(self.queries):
                self._keep()

    def _keep(self) -> None:
        at, ids, scores = (np.concatenate(x) for x in zip((self.at, self.ids, self.scores), *self.more, strict=True))
        self.more = []
        at, ids, scores, rank = _ranked(at, ids, scores)
        full = rank == self.k - 1
        self.floors[at[full]], self.floor_ids[at[full]] = scores[full], ids[full]
        self.at, self.ids, self.scores = (x[rank < self.k] for x in (at, ids, scores))

    def found(self) -> pa.RecordBatch:
        self._keep()
        return pa.RecordBatch.from_pydict({"query_id": self.query_ids[self.at], "vec_id": self.ids, "score": self.scores})


def _distinct(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Where the rows stand that may be among a query's k nearest: of equal vectors those of the k + 1 smallest ids."""
    _, group = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    new = np.append(True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]))
    nth = np.cumsum(new)
    return np.sort(order[nth - nth[np.searchsorted(group, group)] <= k])


def _packed(rows: DataFrame, size: int, kind: str, k: int = 0) -> DataFrame:
    """One row for each block: ids, vectors as numbers of the kind, and floors where rows have them. k: equal vectors of a block are thinned out for it."""
    floors = "floor" in rows.columns

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(parts):
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            if k:
                keep = _distinct(columns[0], columns[1], k)
                columns = [x[keep] for x in columns]
            return pd.DataFrame({n: [x.astype(t).tobytes()] for n, t, x in zip(("ids", "rows", "floors", "floor_ids"), ("<i8", kind, "<f8", "<i8"), columns, strict=False)})

        parts, held = [], 0
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch["id"].to_numpy(), np.stack(batch["vector"].to_numpy()).astype(kind)]
            if floors:
                columns += [batch["floor"].to_numpy(), batch["floor_id"].to_numpy()]
            while len(columns[0]):
                n = min(size - held, len(columns[0]))
                parts.append([x[:n] for x in columns])
                held += n
                columns = [x[n:] for x in columns]
                if held == size:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return rows.mapInPandas(pack, "ids binary, rows binary" + ", floors binary, floor_ids binary" * floors)


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k largest inner products over all candidates but its own id, exact.

    Both frames have id and vector. Ties go to the smaller id; rows that repeat an id count one by one. Vectors that are
    null, all zero, hold null or non-finite components, or differ in length from the longest common length (that of
    most candidates, the longer of two as common) take no part, nor do null ids. With fewer candidates, all of them.
    No usable rows: no rows. Every query block meets every candidate block once; tiles hold block * block / 4 numbers.
    """
    spark = candidates.sparkSession
    common = candidates.where("vector IS NOT NULL").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = common["n"] if common else 0
    kind = "<f4" if all(x.schema["vector"].dataType.elementType == FloatType() for x in (candidates, queries)) else "<f8"
    numbers = "array<float>" if kind == "<f4" else "array<double>"
    usable, asked = (x.select(F.col("id").cast("long").alias("id"), F.col("vector").cast(numbers).alias("vector")).where(F.col("id").isNotNull() & _usable(F.col("vector"), dims)) for x in (candidates, queries))
    total, n_asked = usable.count(), asked.count()
    if not total or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    steps = 0
    while total > FIRST * block * STEP**steps:
        steps += 1
    size = block // 4
    at = F.pmod(F.xxhash64("id"), F.lit(STEP**steps))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, own = None, None
        for batch in batches:
            for i, one in enumerate(batch["asked"].to_pylist()):
                cell = {n: batch[n][i].as_buffer() for n in batch.schema.names if n != "asked"}
                if one != own:
                    if lists is not None:
                        yield lists.found()
                    of = np.frombuffer(cell["query_rows"], kind).reshape(-1, dims).astype(np.float64)
                    own, lists = one, Lists(of, *(np.frombuffer(cell[n], t) for n, t in (("query_ids", "<i8"), ("floors", "<f8"), ("floor_ids", "<i8"))), k)
                lists.add(np.frombuffer(cell["rows"], kind).reshape(-1, dims).astype(np.float64), np.frombuffer(cell["ids"], "<i8"))
        if lists is not None:
            yield lists.found()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = (x.to_numpy() for x in batch["found"].flatten().flatten())
            at = np.repeat(np.arange(batch.num_rows), batch["found"].value_lengths().to_numpy())
            at, ids, scores, rank = _ranked(at, ids, scores)
            near = rank < k
            yield pa.RecordBatch.from_pydict({"query_id": batch["query_id"].to_numpy()[at[near]], "rank": (rank[near] + 1).astype(np.int32), "vec_id": ids[near], "score": scores[near]})

    found = None
    for step in range(steps, -1, -1):
        share = (at % STEP**step == 0) & (F.lit(step == steps) | (at % STEP ** (step + 1) != 0))
        base = stored(_packed(usable.where(share), block, kind, k), "vectors", FILE)
        floors = F.lit(float("-inf")).alias("floor"), F.lit(0).cast("long").alias("floor_id")
        if found is None:
            waiting = asked.select("id", "vector", *floors)
        else:
            last = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
            waiting = asked.hint("merge").join(last, "id", "left").fillna(float("-inf"), ["floor"]).fillna(0, ["floor_id"])
        blocks = _packed(waiting.repartition(max(-(-n_asked // size), min(n_asked // 64 + 1, spark.sparkContext.defaultParallelism))), size, kind)
        blocks = stored(blocks.withColumnsRenamed({"ids": "query_ids", "rows": "query_rows"}).withColumn("asked", F.monotonically_increasing_id()), "queries")
        short = blocks.hint("shuffle_replicate_nl").crossJoin(base).mapInArrow(search, "query_id long, vec_id long, score double")
        if found is not None:
            short = short.unionByName(found.drop("rank"))
        found = short.groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("found")).mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
        if step:
            found = stored(found, "nearest")
    return found


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, rows.where(F.col("id") % 20 == 0))


OP4_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
