"""Remove repeated passages: every byte covered by a 50-byte string that also starts in a document with a smaller id.

1. Texts are held in batches. Each 50-byte window is named by the least hash of its 24-byte strings; neighbouring windows
   of one name form a run (50 bytes and more), so equal windows always lie in runs of the same name. A batch sends each
   distinct run once, as hashes of its name (48 bits) and its bytes (64 bits) and its least document.
2. The runs of a name meet. Where all of them are equal, their least document holds for all their windows.
   Where they differ, one copy of each is asked for, and these few texts are matched window by window:
3. The runs from different batches form shards, each with a Burrows-Wheeler transform. The transforms are merged by iterative
   interleave refinement: the interleave is a sequence of shard numbers; one pass places each of them by the symbols that
   precede its rotation, which extends the common prefix by as many bytes as a symbol has. Breaks between unequal prefixes
   are carried along, so after 10 passes (25 in large merges) the unbroken intervals are the rotations with 50 bytes in
   common. No suffix is compared or sorted across shards.
4. What was found goes back to the batches, which cut the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, new_path, stored, table
from tidemark.llm.hashing import BYTE, STEP, U, from_six, mixed, prefix_sums, six_bytes, spans

LENGTH, NAME = 50, 24
BATCH_BYTES, BATCH_DOCS = 2_000_000, 4096
#: Bytes of text for each bucket of names.
BUCKET_BYTES = 16_000_000
#: Bytes of runs that are merged at once, if they have more than one name: their strings can be numbered in 16 bits.
MERGE_BYTES = 60_000
#: Stands for a null doc_id: no document has a larger id.
LAST = np.iinfo(np.int64).max


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, name and content hash of each run of the documents that end at ends."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2
    x = BYTE[data]
    h2 = x[:-1] * STEP[0] + x[1:]
    h4 = h2[:-2] * STEP[1] + h2[2:]
    h8 = h4[:-4] * STEP[2] + h4[4:]
    h16 = h8[:-8] * STEP[3] + h8[8:]
    least = mixed(h16[:-8] * STEP[4] + h8[16:])
    del h2, h4, h8, h16
    for step in (1, 2, 4, 8, 11):  # 27 strings of 24 bytes in a window
        least = np.minimum(least[:-step], least[step:])
    within = np.ones(n - LENGTH + 1, bool)
    begins = np.concatenate([[0], ends[:-1]])
    for a, b in zip(np.maximum(ends - LENGTH + 1, begins).tolist(), ends.tolist()):
        within[a:b] = False
    new = within.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~within[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return first, first, least[:0], least[:0]
    old = within.copy()
    old[:-1] &= new[1:] | ~within[1:]
    last = np.flatnonzero(old)
    return first, last, least[first], spans(prefix_sums(data), first, last + LENGTH)


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of text, in an order right for 64 bytes at least."""
    n = len(text)
    key = np.resize(text, n + 8).astype(U)
    for by in (1, 2, 4):
        key = (key[:-by] << U(8 * by)) | key[by:]
    key, by = key[:n], 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if by >= 64 or rank[order[-1]] == n - 1:
            return order
        key, by = rank * (n + 1) + np.take(rank, np.arange(by, by + n), mode="wrap"), by * 2


def _symbols(shards: list[np.ndarray], orders: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """For each rotation in order a number for the bytes before it, ascending with them, and how many bytes these are:
    5 where so many strings fit 16 bits, else 2."""
    for size in (5, 2):
        keys = []
        for s, order in zip(shards, orders, strict=True):
            key = np.zeros(len(s), U)
            for k in range(size, 0, -1):
                key = key << U(8) | np.roll(s, k).astype(U)
            keys.append(key[order])
        every = np.concatenate(keys)
        if size == 2:
            return every.astype(np.uint16), size
        by = np.argsort(every)
        rank = np.concatenate([[0], np.cumsum(np.diff(every[by]) != 0)]) if len(by) else by
        if not len(by) or rank[-1] < 1 << 16:
            out = np.empty(len(by), np.uint16)
            out[by] = rank
            return out, size


def common_intervals(shards: list[np.ndarray], depth: int = LENGTH) -> list[np.ndarray]:
    """For each position of each shard the number of its interval: rotations with depth bytes in common (depth in tens).

    Of a shard the merge sees its transform only: for each rotation in order, the bytes before it.
    """
    orders = [rotations(s) for s in shards]
    before, size = _symbols(shards, orders)
    kind = np.uint8 if len(shards) < 256 else np.uint16
    interleave = np.repeat(np.arange(len(shards), dtype=kind), [len(s) for s in shards])
    interval = np.zeros(len(before), np.int32)
    symbol = np.empty_like(before)
    for _ in range(depth // size):
        symbol[np.argsort(interleave, kind="stable")] = before
        place = np.argsort(symbol, kind="stable")
        interleave, interval, now = interleave[place], interval[place], symbol[place]
        broken = np.zeros(len(now), np.int32)
        broken[1:] = (now[1:] != now[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(broken, dtype=np.int32)
    by_shard, out, at = interval[np.argsort(interleave, kind="stable")], [], 0
    for order in orders:
        found = np.empty(len(order), np.int32)
        found[order] = by_shard[at : at + len(order)]
        out.append(found)
        at += len(order)
    return out


def earliest(texts: list[bytes], documents: np.ndarray, shard_of: np.ndarray) -> list[np.ndarray]:
    """For each run and each of its windows, the least document of the runs that hold an equal window."""
    shards, places = [], np.empty(len(texts), np.int64)
    base = 0
    for s in np.unique(shard_of):
        own, at = np.flatnonzero(shard_of == s), 0
        for i in own.tolist():
            places[i] = base + at
            at += len(texts[i])
        shards.append(np.frombuffer(b"".join(texts[i] for i in own.tolist()), np.uint8))
        base += at
    interval = np.concatenate(common_intervals(shards))
    sizes = np.array([len(t) - LENGTH + 1 for t in texts])
    starts = np.repeat(places - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    of, least = interval[starts], np.full(int(interval.max()) + 1, LAST)
    np.minimum.at(least, of, np.repeat(documents, sizes))
    return np.split(least[of], np.cumsum(sizes)[:-1])


def _batched(docs: DataFrame) -> DataFrame:
    """Rows of many documents: batch, ids, sizes (little-endian 64-bit) and the compressed bytes of their texts."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def row():
            sizes = np.array([len(t) for t in texts], "<i8")
            return pd.DataFrame({"batch": [part + n], "ids": [np.array(ids, "<i8").tobytes()], "sizes": [sizes.tobytes()], "data": [zstandard.ZstdCompressor(level=1).compress(b"".join(texts))]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object).tolist(), batch["text"], strict=True):
                text = text.encode() if isinstance(text, str) else b""
                if ids and (held + len(text) > BATCH_BYTES or len(ids) >= BATCH_DOCS):
                    yield row()
                    ids, texts, held, n = [], [], 0, n + 1
                ids.append(LAST if pd.isna(doc_id) else int(doc_id))
                texts.append(text)
                held += len(text)
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pack, "batch long, ids binary, sizes binary, data binary")


class _Batch:
    """A batch and its distinct runs, which are numbered bucket by bucket."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, buckets: int):
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.ends = np.cumsum(self.sizes)
        self.raw = zstandard.ZstdDecompressor().decompress(data)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.first, self.last, name, content = runs(self.data, self.ends)
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        # names are least hashes, of which small ones are common
        bucket = (mixed(name) % U(buckets)).astype(np.int64)
        order = np.argsort(mixed(name * STEP[5] + content, 5))
        order = order[np.argsort(bucket[order].astype(np.uint16) if buckets <= 65536 else bucket[order], kind="stable")]
        name, content, bucket = name[order], content[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (content[1:] != content[:-1])
        at = np.flatnonzero(new)
        self.run = np.empty(len(order), np.int64)  # of each run, the number of its distinct one
        self.run[order] = np.cumsum(new) - 1
        self.names, self.contents, self.buckets, self.one = name[at], content[at], bucket[at], order[at]
        self.least = np.minimum.reduceat(self.ids[self.doc[order]], at) if len(at) else self.ids[:0]
        self.edges = np.searchsorted(self.buckets, np.arange(buckets + 1))


def _sent(batches: DataFrame, buckets: int) -> DataFrame:
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples(index=False):
                b = _Batch(x.ids, x.sizes, x.data, buckets)
                out = []
                for k in np.flatnonzero(np.diff(b.edges)).tolist():
                    i, j = b.edges[k], b.edges[k + 1]
                    out.append((k, x.batch, six_bytes(b.names[i:j]), b.contents[i:j].astype("<u8").tobytes(), b.least[i:j].astype("<i8").tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "batch", "names", "contents", "least"])

    return batches.mapInPandas(send, "bucket int, batch long, names binary, contents binary, least binary")


_FOUND = "kind int, bucket int, batch long, run binary, of binary, least binary, lengths binary"


def _compared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket. Kind 0: runs whose least document is not their batch's own; kind 1: runs whose text is wanted; kind 2: where
    those runs occur. run numbers a batch's distinct runs within the bucket, of numbers the bucket's."""
    bucket = int(frame["bucket"].iloc[0])
    sizes = np.array([len(x) // 8 for x in frame["least"]])
    name = np.concatenate([from_six(x, n) for x, n in zip(frame["names"], sizes, strict=True)])
    content = np.concatenate([np.frombuffer(x, "<u8") for x in frame["contents"]])
    least = np.concatenate([np.frombuffer(x, "<i8") for x in frame["least"]])
    batch = np.repeat(frame["batch"].to_numpy(), sizes)
    run = np.concatenate([np.arange(n) for n in sizes])
    order = np.lexsort((run, batch, least, content, name))
    name, content, least, batch, run = name[order], content[order], least[order], batch[order], run[order]
    other = np.ones(len(order), bool)
    other[1:] = name[1:] != name[:-1]
    new = other.copy()
    new[1:] |= content[1:] != content[:-1]
    text = np.cumsum(new) - 1
    heads, groups = np.flatnonzero(new), np.flatnonzero(other)
    best = least[heads][text]
    group = np.cumsum(other) - 1
    texts = np.add.reduceat(new.astype(np.int64), groups)
    apart = np.minimum.reduceat(least, groups) != np.maximum.reduceat(least, groups)
    unlike = ((texts > 1) & apart)[group]
    out = []

    def rows(kind: int, mask: np.ndarray) -> None:
        at = np.flatnonzero(mask)
        at = at[np.argsort(batch[at], kind="stable")]
        for own in np.split(at, np.flatnonzero(np.diff(batch[at])) + 1):
            if len(own):
                out.append((kind, bucket, int(batch[own[0]]), run[own].astype("<i4").tobytes(), np.stack([text[own], group[own]]).astype("<i4").tobytes() if kind else None, best[own].astype("<i8").tobytes(), None))

    rows(0, best < least)
    rows(1, unlike & new)
    rows(2, unlike)
    return pd.DataFrame(out, columns=["kind", "bucket", "batch", "run", "of", "least", "lengths"])


def _matched(key: tuple, texts: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
    """Kind 3, of one bucket: for runs with earlier windows, the least documents of their windows, each with its count."""
    number, group, least, text, shard = [], [], [], [], []
    for x in texts.itertuples(index=False):
        n, g = np.frombuffer(x.of, "<i4").reshape(2, -1)
        number.append(n)
        group.append(g)
        least.append(np.frombuffer(x.least, "<i8"))
        ends = np.cumsum(np.frombuffer(x.lengths, "<i4")).tolist()
        text += [x.data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        shard.append(np.full(len(n), x.batch % 16))
    empty = pd.DataFrame(columns=["kind", "bucket", "batch", "run", "of", "least", "lengths"])
    if not text:
        return empty
    number, group, least, shard = map(np.concatenate, (number, group, least, shard))
    order = np.argsort(group, kind="stable")
    new = np.concatenate([[True], np.diff(group[order]) != 0])
    ends = np.cumsum(np.array([len(t) for t in text])[order])
    name = np.cumsum(new) - 1
    until = ends[np.append(np.flatnonzero(new)[1:], len(new)) - 1]  # bytes up to the end of each name, which stays whole
    ends = np.flatnonzero(np.diff((until // MERGE_BYTES)[name])) + 1
    better: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for own in np.split(order, ends):
        found = earliest([text[i] for i in own.tolist()], least[own], shard[own])
        for i, docs in zip(own.tolist(), found, strict=True):
            if (docs < least[i]).any():
                cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                better[int(number[i])] = docs[cut], np.diff(np.concatenate([cut, [len(docs)]]))
    out = []
    for x in places.itertuples(index=False):
        run, of = np.frombuffer(x.run, "<i4"), np.frombuffer(x.of, "<i4").reshape(2, -1)[0]
        own = [(r, better[o]) for r, o in zip(run.tolist(), of.tolist(), strict=True) if o in better]
        if own:
            counts = np.array([len(v[0]) for _, v in own], "<i4")
            out.append((3, int(key[0]), x.batch, np.array([r for r, _ in own], "<i4").tobytes(), counts.tobytes(), np.concatenate([v[0] for _, v in own]).astype("<i8").tobytes(), np.concatenate([v[1] for _, v in own]).astype("<i4").tobytes()))
    return pd.DataFrame(out, columns=empty.columns)


def _joined(batches: DataFrame, found: DataFrame) -> DataFrame:
    """Each batch with what was found for it; the batches stay where they are."""
    told = found.groupBy("batch").agg(F.collect_list(F.struct("kind", "bucket", "run", "of", "least", "lengths")).alias("told"))
    return batches.join(told.withColumnRenamed("batch", "to"), F.col("batch") == F.col("to"), "left").drop("to")


def _wanted(batches: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples(index=False):
                if x.told is None or not len(x.told):
                    continue
                b, out = _Batch(x.ids, x.sizes, x.data, buckets), []
                for t in x.told:
                    at = b.one[np.frombuffer(t["run"], "<i4") + b.edges[t["bucket"]]]
                    i, j = b.first[at].tolist(), (b.last[at] + LENGTH).tolist()
                    out.append((t["bucket"], x.batch, t["of"], t["least"], (b.last[at] - b.first[at] + LENGTH).astype("<i4").tobytes(), b"".join(b.raw[s:e] for s, e in zip(i, j, strict=True))))
                yield pd.DataFrame(out, columns=["bucket", "batch", "of", "least", "lengths", "data"])

    return _joined(batches, found.where("kind = 1")).where("told IS NOT NULL").mapInPandas(send, "bucket int, batch long, of binary, least binary, lengths binary, data binary")


_COUNTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TEXTS = ", text_sha256 string, kept string, spans array<struct<start:long,stop:long>>"


def _cut(batches: DataFrame, found: DataFrame, buckets: int, texts: bool) -> DataFrame:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples(index=False):
                b = _Batch(x.ids, x.sizes, x.data, buckets)
                least, starts, stops = b.least.copy(), [], []
                told = x.told if x.told is not None else ()
                for t in told:
                    if t["kind"] == 0:
                        least[np.frombuffer(t["run"], "<i4") + b.edges[t["bucket"]]] = np.frombuffer(t["least"], "<i8")
                order = np.argsort(b.run, kind="stable")
                edge = np.searchsorted(b.run[order], np.arange(len(b.one) + 1))
                for t in told:
                    if t["kind"] != 3:
                        continue
                    docs, lengths, at = np.frombuffer(t["least"], "<i8"), np.frombuffer(t["lengths"], "<i4"), 0
                    for r, n in zip((np.frombuffer(t["run"], "<i4") + b.edges[t["bucket"]]).tolist(), np.frombuffer(t["of"], "<i4").tolist(), strict=True):
                        value, ends = docs[at : at + n], np.cumsum(lengths[at : at + n])
                        at += n
                        for k in order[edge[r] : edge[r + 1]].tolist():
                            gone = value < b.ids[b.doc[k]]
                            starts.append(b.first[k] + (ends - lengths[at - n : at])[gone])
                            stops.append(b.first[k] + ends[gone] + LENGTH - 1)
                whole = least[b.run] < b.ids[b.doc]
                starts, stops = np.concatenate([*starts, b.first[whole]]), np.concatenate([*stops, b.last[whole] + LENGTH])
                n = len(b.data) + 1
                gone = np.cumsum(np.bincount(starts.astype(np.int64), minlength=n) - np.bincount(stops.astype(np.int64), minlength=n))[:-1] > 0
                out = []
                begin = 0
                for name, end in zip(b.ids.tolist(), b.ends.tolist(), strict=True):
                    own, text = gone[begin:end], b.raw[begin:end]
                    cuts = np.zeros((0, 2), np.int64)
                    if own.any():
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                        cuts, text = edges.reshape(-1, 2), b.data[begin:end][~own].tobytes()
                    row = (None if name == LAST else name, end - begin, int(own.sum()), len(cuts), hashlib.sha256(text).hexdigest())
                    if texts:
                        row += hashlib.sha256(b.raw[begin:end]).hexdigest(), text.decode(errors="ignore"), [{"start": s, "stop": e} for s, e in cuts.tolist()]
                    out.append(row)
                    begin = end
                frame_ = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_sha256", "kept", "spans"][: 8 if texts else 5])
                yield frame_.assign(doc_id=frame_["doc_id"].astype("Int64"))

    return _joined(batches, found).mapInPandas(cut, _COUNTS + _TEXTS * texts)


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs; with texts also text_sha256 (of the whole
    text), kept (what is left, without the bytes of characters that were cut in two) and spans (removed, as byte ranges).

    docs has doc_id and text. Null texts count as empty, and texts under 50 bytes keep all. Rows that share a doc_id
    do not remove each other's bytes, as neither id is smaller; a null doc_id counts as larger than all and stays null.
    Matches are judged on the input. Other columns are left out. No rows: no rows. Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    path = new_path(spark, "batches")
    name = "batches_" + path.rpartition("-")[2]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written in buckets by batch: what is found for a batch comes to it, and no text is shuffled.
    _batched(docs).write.bucketBy(parts, "batch").option("path", path).saveAsTable(name)
    batches = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay until the driver's JVM ends, as new_path has it
    total = batches.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(parts, 2 * total // BUCKET_BYTES)
    found = stored(_sent(batches, buckets).groupBy("bucket").applyInPandas(_compared, _FOUND), "runs")
    wanted = _wanted(batches, found, buckets)
    matched = wanted.groupBy("bucket").cogroup(found.where("kind = 2").groupBy("bucket")).applyInPandas(_matched, _FOUND)
    return _cut(batches, found.where("kind = 0").unionByName(matched), buckets, texts)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of their texts; documents left with white space only go.

    What is cut follows from doc_id and text, so rows are named by these, null doc_ids too, which count as larger than all.
    n_chars, where docs has it, follows the text; other columns stay.
    """
    named = docs.withColumn("text", F.coalesce("text", F.lit("")))
    kept = without_repeats(named).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__was"), F.col("kept").alias("__kept")).dropDuplicates(["__id", "__was"])
    rest = named.withColumn("__text", F.sha2("text", 256)).drop("text")
    out = rest.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__was"))).withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike(WORD)).select(*docs.columns)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), texts=False)
