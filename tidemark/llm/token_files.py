"""Token ids in binary files with Elias-Fano boundaries.

A file holds the ids of consecutive documents, one after another, then the documents' ends and the documents' ids
as Elias-Fano sequences, then a footer. A sequence of n values below u takes about n * (2 + log2(u / n)) bits;
sampled positions of its ones let a reader start anywhere without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, table
from tidemark.llm.tokens import VOCABULARY, encoder

MAGIC = b"TIDEEF01"
#: Every so many ones, the position of one is stored.
SAMPLE = 256
#: A file is closed at so many ids or documents.
FILE_IDS, FILE_DOCS = 16_000_000, 1_000_000
#: Bytes of text in the range of doc ids that one task writes, on average.
RANGE_BYTES = 64_000_000
_FOOTER = struct.Struct("<QQQQqQB7x8s")  # ids, documents, bytes of ends, bytes of doc ids, least doc id, null doc ids, bytes an id


class EliasFano:
    """Non-decreasing whole numbers from 0 up."""

    _HEAD = struct.Struct("<QQB7x")

    def __init__(self, data: bytes):
        self.n, top, self.low_bits = self._HEAD.unpack_from(data)
        at = self._HEAD.size
        sizes = ((self.n * self.low_bits + 7) // 8, (self.n + (top >> self.low_bits) + 8) // 8, 4 * -(-self.n // SAMPLE))
        self.low, self.high, samples = (np.frombuffer(data, np.uint8, s, at + sum(sizes[:i])) for i, s in enumerate(sizes))
        self.samples = samples.view("<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        n = len(values)
        values = np.asarray(values, np.int64)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        step = 1 << 13  # a multiple of 8 values fills whole bytes
        low = b"".join(np.packbits(((values[i : i + step, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() for i in range(0, n, step))
        ones = (values >> bits) + np.arange(n)
        high = np.zeros((n + (top >> bits) + 8) // 8 * 8, np.uint8)
        high[ones] = 1
        return cls._HEAD.pack(n, top, bits) + low + np.packbits(high, bitorder="little").tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def __len__(self) -> int:
        return self.n

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop - 1, read from the sample before start on."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.int64)
        first = int(self.samples[start // SAMPLE])
        end = int(self.samples[-(-stop // SAMPLE)]) if -(-stop // SAMPLE) < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : end // 8 + 1], bitorder="little")) + first // 8 * 8
        skip = int(np.searchsorted(ones, first)) + start % SAMPLE
        high = ones[skip : skip + stop - start] - np.arange(start, stop)
        if not self.low_bits:
            return high
        begin = start * self.low_bits
        packed = np.unpackbits(self.low[begin // 8 : (stop * self.low_bits + 7) // 8], bitorder="little")[begin % 8 :][: (stop - start) * self.low_bits]
        return (high << self.low_bits) + packed.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def __getitem__(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])


class Writer:
    """Writes one file under a name of its own and moves it to its place when whole, so that a repeated task does no harm."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.draft, self.width = f"{self.path}.{uuid.uuid4().hex}", width
        self.out = self.fs.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.ends, self.ids, self.total = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.total += len(ids) // self.width
        self.ends.append(self.total)
        self.ids.append(doc_id)

    @property
    def full(self) -> bool:
        return self.total >= FILE_IDS or len(self.ends) >= FILE_DOCS

    def close(self) -> tuple[int, int]:
        """Documents and ids written. Doc ids come ascending, nulls first."""
        nulls = sum(x is None for x in self.ids)
        known = np.array(self.ids[nulls:], np.int64)
        least = int(known[0]) if len(known) else 0
        ends, ids = EliasFano.encode(np.array(self.ends, np.int64)), EliasFano.encode(known - least)
        self.out.write(ends + ids + _FOOTER.pack(self.total, len(self.ends), len(ends), len(ids), least, nulls, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.path)
        return len(self.ends), self.total


class Reader:
    def __init__(self, path: str):
        at, path = fs.FileSystem.from_uri(path)
        self.file = at.open_input_file(path)
        size = self.file.size()
        self.total, self.n, ends, ids, self.least, self.nulls, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        both = self.file.read_at(ends + ids, size - _FOOTER.size - ends - ids)
        self.ends, self.known = EliasFano(both[:ends]), EliasFano(both[ends:])

    def documents(self, start: int, stop: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, ids before it in this file, its ids) of documents start to stop - 1."""
        stop = min(stop, self.n)
        if start >= stop:
            return
        ends = self.ends.select(start, stop)
        begin = self.ends[start - 1] if start else 0
        ids = np.frombuffer(self.file.read_at((int(ends[-1]) - begin) * self.width, len(MAGIC) + begin * self.width), f"<u{self.width}")
        names = [None] * max(0, min(stop, self.nulls) - start)
        names += (self.known.select(max(0, start - self.nulls), max(0, stop - self.nulls)) + self.least).tolist()
        at = begin
        for name, end in zip(names, ends.tolist(), strict=True):
            yield name, at, ids[at - begin : end - begin]
            at = end

    def __iter__(self):
        for i in range(0, self.n, 1024):
            yield from self.documents(i, i + 1024)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = 2) -> DataFrame:
    """path, ids_before, n_docs, n_ids of each file written, in ascending order of doc_id over all files.

    docs has doc_id (whole numbers) and text; end is appended to each document. Null and empty texts: the end id alone.
    Null doc_ids come first; rows that share a doc_id are documents of their own, ordered by text. Other columns are
    left out. No rows: no files. A task streams its documents to its files; the driver gets one row a file.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, part, done, out = encoder(vocabulary), TaskContext.get().partitionId(), [], None
        last = np.array([end], code.dtype).tobytes()

        def close():
            done.append((out_path, part, len(done), *out.close()))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object).tolist(), batch["text"], strict=True):
                if out is None:
                    out_path = f"{path}/part-{part:06d}-{len(done):06d}.ids"
                    out = Writer(out_path, code.dtype.itemsize)
                out.add(None if pd.isna(doc_id) else int(doc_id), code.encode(text if isinstance(text, str) else None) + last)
                if out.full:
                    close()
                    out = None
        if out:
            close()
        yield pd.DataFrame(done, columns=["path", "part", "nth", "n_docs", "n_ids"])

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // RANGE_BYTES)
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = rows.mapInPandas(write, "path string, part long, nth long, n_docs long, n_ids long").collect()
    before, out = 0, []
    for f in sorted(files, key=lambda f: (f["part"], f["nth"])):
        out.append((f["path"], before, f["n_docs"], f["n_ids"]))
        before += f["n_ids"]
    return spark.createDataFrame(out, "path string, ids_before long, n_docs long, n_ids long")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in files of write_tokens."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, before in zip(batch["path"], batch["ids_before"], strict=True):
                rows = [(name, before + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for name, at, ids in Reader(path)]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return files.repartition(max(1, files.count()), "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens")))
