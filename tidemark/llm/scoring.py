"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

The last CONTEXT words' vectors, each scaled by its distance's weights, add up to a prediction. Its product with an output
vector, plus a bias, is a score. Every word counted often enough (see least_count) has an input and an output vector of its
own, so the model grows with the corpus. These words, by falling count, form classes: the commonest stand alone, and a class
further down holds about as many words as the square root of its rank asks for. A word's probability is that of its class times
that inside its class, each from one matrix product, so that it is normalised over all words. All rarer words are GROUPS of
their own by shape and ending; within a group words share its probability by their counts.

Training contrasts each token with noise from the unigram distribution, at both levels, so it never normalises. It runs in
rounds over disjoint parts of the training documents: each task continues from the common model over all its tokens of the
round and sends the rows of the model that it changed; these are averaged row by row.

Texts are split into words once: chunks of documents are kept as numbers with the words they stand for. Counts of all words
stay in a table: the bounded head of it goes to every task, the rest is joined by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

CONTEXT, WIDTH = 4, 15
#: A word has vectors of its own if its count is at least the larger of LEAST (fewer say too little about as many numbers) and
#: the square root of all tokens divided by FEW: both the words with vectors and what each of them learns from grow with the corpus.
LEAST, FEW = 50, 10
#: Words whose counts each task holds, and so words with vectors at most: some 30 MB of model. No word of more bytes is among them.
HEAD, HEAD_BYTES = 200_000, 64
#: Words that are classes of their own, and how much a class grows with the square root of its rank.
SINGLE, SPREAD = 64, 4.0
ENDINGS = 4
GROUPS = 16 * ENDINGS
ROUNDS, STEP, BATCH = 3, 0.2, 4096
#: Noise words for each token among classes, of which a batch shares SHARED draws, and inside a class.
NOISE, SHARED, INNER = 20, 64, 2
#: Stands for the end of a text; no word is empty.
END = b""
#: Bytes of text and documents in a chunk.
CHUNK_BYTES, CHUNK_DOCS = 3_000_000, 1 << 16
#: Rows of the model that are averaged together.
BLOCK = 4096


def groups_of(data: bytes, lengths: np.ndarray) -> np.ndarray:
    """Groups of words that follow each other in data: last character, plain letters or not, short or long, and a hash of the last letters."""
    n, ends = np.asarray(lengths, np.int64), np.cumsum(lengths, dtype=np.int64)
    raw = np.concatenate([np.zeros(3, np.uint8), np.frombuffer(data, np.uint8)]).astype(np.int64)
    last = raw[ends + 2] * (n > 0)
    letter = (last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57))
    kind = np.where(last == ord("."), 1, np.where(last == ord(","), 2, np.where(letter, 0, 3)))
    high = np.concatenate([[0], np.cumsum(raw[3:] >= 128)])
    foreign = high[ends] > high[ends - n]
    at = ends + 2 - (kind > 0)  # the last letter, and the one before it
    pair = raw[at] * (n > (kind > 0)) * 256 + raw[at - 1] * (n > 1 + (kind > 0))
    return ENDINGS * (kind + 4 * foreign + 8 * (n > 6)) + ((pair * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % ENDINGS


def least_count(total: int) -> int:
    return max(LEAST, math.isqrt(total) // FEW)


class Vocabulary:
    """The head of the counts. Symbols number the words with vectors, then the groups; classes number the outputs."""

    def __init__(self, head: list[tuple[bytes, int]], groups: np.ndarray, total: int, distinct: int):
        head = [(END, dict(head).get(END, 0)), *sorted(((w, c) for w, c in head if w != END), key=lambda x: (-x[1], x[0]))]
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], np.int64)
        self.log = np.log10(self.counts + 1.0)
        self.total, self.distinct = total, distinct
        kind = groups_of(b"".join(w for w, _ in head), [len(w) for w, _ in head])
        self.own = n = 1 + int((self.counts[1:] >= least_count(total)).sum())
        self.symbol = np.where(np.arange(len(head)) < n, np.arange(len(head)), n + kind).astype(np.int32)
        edges = list(range(min(n, SINGLE) + 1))
        while edges[-1] < n:
            edges.append(min(n, edges[-1] + max(8, int(SPREAD * math.sqrt(edges[-1])))))
        self.edges = np.array(edges)  # symbols edges[c] to edges[c + 1] - 1 are class c
        self.inside = len(edges) - 1
        sizes = np.diff(self.edges)
        self.classes = np.concatenate([np.repeat(np.arange(self.inside), sizes), self.inside + np.arange(GROUPS)]).astype(np.int32)
        self.wide = np.concatenate([sizes > 1, np.zeros(GROUPS, bool)])
        mass = groups.astype(float)  # rows of (tokens, distinct words) of all words by group
        np.subtract.at(mass, kind[:n], np.stack([self.counts[:n], self.counts[:n] > 0], axis=1))
        self.group_log = np.log10(mass.sum(axis=1) + 1)
        word = self.counts[:n] + 1.0
        self.up_to = np.concatenate([[0.0], np.cumsum(word)])
        known = np.concatenate([self.up_to[self.edges[1:]] - self.up_to[self.edges[:-1]], mass[:, 0] + 1])
        self.unigram = known / known.sum()
        self.inner = np.log(word / known[self.classes[:n]])

    def numbers(self, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words that follow each other in data: symbol, log10(count + 1), and 1 where counted, 0 where not, -1 where not in the head."""
        at = np.fromiter(map(self.index.get, _words(data, lengths).to_pylist(), repeat(-1)), np.int64, len(lengths))
        far = at < 0
        symbol = np.where(far, self.own + groups_of(data, lengths), self.symbol[at]).astype(np.int32)
        return symbol, np.where(far, 0.0, self.log[at]), np.where(far, -1, self.counts[at] > 0).astype(np.int8)


class Model:
    """Parameters in one matrix of WIDTH + 1 columns: inputs, classes with biases, words inside classes with biases, distance weights."""

    def __init__(self, vocabulary: Vocabulary, matrix: np.ndarray):
        v = self.vocabulary = vocabulary
        self.matrix = np.array(matrix, np.float32)
        self.at = np.cumsum([0, v.own + GROUPS, v.inside + GROUPS, v.own, CONTEXT])
        self.inputs, self.outer, self.words, self.weights = (self.matrix[a:b] for a, b in zip(self.at, self.at[1:], strict=False))

    @classmethod
    def start(cls, v: Vocabulary, seed: int = 5) -> Model:
        rows = 2 * v.own + v.inside + 2 * GROUPS + CONTEXT
        out = cls(v, np.random.default_rng(seed).normal(0, 0.1, (rows, WIDTH + 1)))
        out.words[:, :WIDTH] *= 0.3
        out.inputs[:, WIDTH] = out.weights[:, WIDTH] = 0
        out.weights[:, :WIDTH] = 1 / (1 + np.arange(CONTEXT))[:, None]
        out.outer[:, WIDTH], out.words[:, WIDTH] = np.log(v.unigram), v.inner
        return out

    def predicted(self, symbols: np.ndarray, age: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Predictions, with a last column of ones, for tokens at to stop - 1, and the input rows from CONTEXT tokens before on.

        age counts the tokens before a token in its text; before a text stand ends of texts.
        """
        before, n = symbols[max(0, at - CONTEXT) : stop], stop - at
        rows = self.inputs.take(np.concatenate([np.zeros(max(0, CONTEXT - at), before.dtype), before]), axis=0)
        out, one = rows[CONTEXT - 1 : CONTEXT - 1 + n] * self.weights[0], np.empty((n, WIDTH + 1), np.float32)
        for k in range(1, CONTEXT):
            out += np.multiply(rows[CONTEXT - 1 - k : CONTEXT - 1 - k + n], self.weights[k], out=one)
        early = np.flatnonzero(age[at:stop] < CONTEXT)
        for k in range(CONTEXT if len(early) else 0):
            first = early[age[at + early] <= k]
            out[first] += (self.inputs[0] - rows[CONTEXT - 1 - k + first]) * self.weights[k]
        out[:, WIDTH] = 1
        return out, rows

    def log10(self, symbols: np.ndarray, starts: np.ndarray, size: int = 131_072) -> np.ndarray:
        """Normalised log10 probabilities of symbols after their contexts."""
        v, age, out = self.vocabulary, ages(len(symbols), starts), np.empty(len(symbols))
        for i in range(0, len(symbols), size):
            own = symbols[i : i + size]
            r, _ = self.predicted(symbols, age, i, i + len(own))
            which = v.classes[own]
            out[i : i + size] = _normalised(r, self.outer, which)
            at = np.flatnonzero(v.wide[which])
            at = at[np.argsort(which[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(which[at])) + 1
            for same in np.split(at, cuts) if len(at) else ():
                a, b = v.edges[which[same[0]]], v.edges[which[same[0]] + 1]
                out[i + same] += _normalised(r[same], self.words[a:b], own[same] - a)
        return out / math.log(10)


def ages(n: int, starts: np.ndarray) -> np.ndarray:
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _normalised(r: np.ndarray, outputs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Logs of the softmax of r times outputs at own; blocks of rows stay in a core's cache."""
    out, step = np.empty(len(r), np.float32), max(16, 262_144 // len(outputs))
    across, ones = np.ascontiguousarray(outputs.T), np.ones(len(outputs), np.float32)
    safe = np.sqrt((r**2).sum(axis=1).max(initial=0) * (outputs**2).sum(axis=1).max()) < 80  # no exponential can overflow or all vanish
    for i in range(0, len(r), step):
        scores = r[i : i + step] @ across
        if not safe:
            scores -= scores.max(axis=1, keepdims=True)
        mine = scores[np.arange(len(scores)), own[i : i + step]]
        np.exp(scores, out=scores)
        out[i : i + step] = mine - np.log(scores @ ones)
    return out


class Trainer:
    """Stochastic gradient steps (AdaGrad, by row) on the contrast of data with noise."""

    def __init__(self, model: Model, seed: int):
        self.model, self.random = model, np.random.default_rng(seed)
        v = model.vocabulary
        self.past, self.touched = np.ones(len(model.matrix), np.float32), np.zeros(len(model.matrix), np.float32)
        self.outer_noise = np.log(NOISE * v.unigram).astype(np.float32)
        self.inner_noise = (v.inner + math.log(INNER)).astype(np.float32)
        self.up_to = np.cumsum(v.unigram)
        # Inside a class noise is drawn from a pool that has each word about as often as its count asks for.
        self.many = 8 * np.diff(v.edges)
        self.pool_at = np.cumsum(self.many) - self.many
        nth = (np.arange(self.many.sum()) - np.repeat(self.pool_at, self.many) + 0.5) / np.repeat(self.many, self.many)
        low, high = (np.repeat(v.up_to[x], self.many) for x in (v.edges[:-1], v.edges[1:]))
        self.pool = np.minimum(np.searchsorted(v.up_to, low + nth * (high - low), side="right") - 1, v.own - 1)

    def _step(self, part: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows)
        rows = rows.take(order)
        at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total, own = np.add.reduceat(gradient.take(order, axis=0), at, axis=0), self.model.at[part] + rows.take(at)
        past = self.past.take(own) + np.einsum("nd,nd->n", total, total) / (WIDTH + 1)
        self.past[own] = past
        total *= (STEP / np.sqrt(past))[:, None]
        self.model.matrix[own] = self.model.matrix.take(own, axis=0) - total
        self.touched[own] += 1

    def learn(self, symbols: np.ndarray, age: np.ndarray, at: int, stop: int) -> None:
        m, v, n = self.model, self.model.vocabulary, stop - at
        own, (r, rows) = symbols[at:stop], m.predicted(symbols, age, at, stop)
        which = v.classes.take(own)
        noise = np.minimum(np.searchsorted(self.up_to, self.random.random(SHARED)), len(self.up_to) - 1)
        mine, other = m.outer.take(which, axis=0), m.outer[noise]
        g = _sigmoid(np.einsum("nd,nd->n", r, mine) - self.outer_noise.take(which)) - 1
        h = r @ other.T
        h -= self.outer_noise[noise]
        h = _sigmoid(h)
        h *= NOISE / SHARED
        dr = h @ other
        mine *= g[:, None]
        dr += mine
        gradient = np.empty((n + SHARED, WIDTH + 1), np.float32)
        np.multiply(g[:, None], r, out=gradient[:n])
        np.matmul(h.T, r, out=gradient[n:])
        steps = [(1, np.concatenate([which, noise]), gradient)]
        wide = np.flatnonzero(v.wide.take(which))
        if len(wide):
            of, near = which.take(wide), r.take(wide, axis=0)
            draws = self.pool.take(self.pool_at.take(of)[:, None] + (self.random.random((len(wide), INNER)) * self.many.take(of)[:, None]).astype(np.int64))
            words = np.concatenate([own.take(wide)[:, None], draws], axis=1)
            vectors = m.words.take(words, axis=0)
            slope = _sigmoid(np.einsum("nkd,nd->nk", vectors, near) - self.inner_noise.take(words))
            slope[:, 0] -= 1
            dr[wide] += np.einsum("nk,nkd->nd", slope, vectors)
            np.multiply(slope[:, :, None], near[:, None], out=vectors)
            steps.append((2, words.ravel(), vectors.reshape(-1, WIDTH + 1)))
        dr[:, WIDTH] = 0
        pushed, ends, back = np.zeros_like(rows), np.zeros(WIDTH + 1, np.float32), np.empty_like(dr)
        weights, some = np.zeros((CONTEXT, WIDTH + 1), np.float32), min(n, 512)  # so few weights learn enough from a part
        early = np.flatnonzero(age[at:stop] < CONTEXT)
        for k in range(CONTEXT):
            place, first = CONTEXT - 1 - k, early[age[at + early] <= k]
            np.multiply(dr, m.weights[k], out=back)
            weights[k] = (rows[place : place + some] * dr[:some]).sum(axis=0)
            if len(first):
                weights[k] += ((m.inputs[0] - rows[place + first[first < some]]) * dr[first[first < some]]).sum(axis=0)
                ends += back[first].sum(axis=0)
                back[first] = 0
            pushed[place : place + n] += back
        skip = max(0, CONTEXT - at)
        steps.append((0, np.append(symbols[at + skip - CONTEXT : stop], 0), np.concatenate([pushed[skip:], ends[None]])))
        for part, at_, gradient in [*steps, (3, np.arange(CONTEXT), weights * (n / some / 100))]:
            self._step(part, at_, gradient)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    with np.errstate(over="ignore"):  # then it is 0
        np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_CHUNKS = "chunk long, doc_ids binary, nulls binary, held binary, sizes binary, ids binary, words binary, lengths binary, counts binary"


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents as numbers of words in rows of many documents, each with its words and how often training documents have them.

    A word is a run of other bytes than space and control white space, with A-Z in lower case; 0 is the end of a text.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId() << 24, 0
        numbers, docs_, held_bytes = _Numbers({END: 0}), [], 0

        def row() -> pa.RecordBatch:
            ids, held = np.concatenate([d[2] for d in docs_]), np.array([d[1] for d in docs_])
            sizes, words = np.array([len(d[2]) for d in docs_]), list(numbers)
            counts = np.bincount(ids[~np.repeat(held, sizes)], minlength=len(words))
            names = np.array([d[0] or 0 for d in docs_], "<i8"), np.array([d[0] is None for d in docs_], np.uint8)
            fields = [*(x.tobytes() for x in names), held.astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes(), ids.astype("<u4").tobytes(), b"".join(words), np.array([len(w) for w in words], "<i4").tobytes(), counts.astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([part + n]), *(pa.array([x], pa.binary()) for x in fields)], [f.split()[0] for f in _CHUNKS.split(", ")])

        for batch in batches:
            for doc_id, text, held in zip(*(batch[c] for c in ("doc_id", "text", "held_out")), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                words.append(END)
                docs_.append((doc_id.as_py(), held.as_py(), np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))))
                held_bytes += text.as_buffer().size if text.is_valid else 0
                if held_bytes >= CHUNK_BYTES or len(docs_) >= CHUNK_DOCS:
                    yield row()
                    numbers, docs_, held_bytes, n = _Numbers({END: 0}), [], 0, n + 1
        if docs_:
            yield row()

    return docs.mapInArrow(split, _CHUNKS)


def _words(data: bytes, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, as each is large."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _counts(chunks: DataFrame) -> DataFrame:
    """word, n of all tokens of the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _each(batch):
                n = np.frombuffer(x["counts"], "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([_words(x["words"], np.frombuffer(x["lengths"], "<i4")).take(pa.array(at)), pa.array(n[at])], ["word", "n"])

    return chunks.select("words", "lengths", "counts").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    def by_group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((GROUPS, 2), np.int64)
        for frame in frames:
            own = groups_of(b"".join(frame["word"]), frame["word"].str.len().to_numpy(np.int64))
            out[:, 0] += np.bincount(own, frame["n"], GROUPS).astype(np.int64)
            out[:, 1] += np.bincount(own, minlength=GROUPS)
        yield pd.DataFrame({"kind": range(GROUPS), "tokens": out[:, 0], "words": out[:, 1]})

    sums = counts.mapInPandas(by_group, "kind int, tokens long, words long").groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    groups = np.zeros((GROUPS, 2), np.int64)
    for r in sums:
        groups[r["kind"]] = r["tokens"], r["words"]
    short = counts.where(F.length("word") <= HEAD_BYTES).withColumn("rank", F.floor(F.log2("n") * 8).cast("int"))
    held, least = 0, None  # whole ranks of counts, from the top down, while they fit: no sort, and no task sends more than the head
    for r in sorted(short.groupBy("rank").count().collect(), key=lambda r: -r["rank"]):
        held += r["count"]
        if held > HEAD:
            break
        least = r["rank"]
    head = [] if least is None else short.where(F.col("rank") >= least).select("word", "n").collect()
    return Vocabulary([(bytes(r["word"]), r["n"]) for r in head], groups, int(groups[:, 0].sum()), int(groups[:, 1].sum()))


def _tokens(x, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of a chunk: numbers of its tokens, sizes of its documents, and what vocabulary.numbers gives for its words."""
    found = vocabulary.numbers(x["words"], np.frombuffer(x["lengths"], "<i4"))
    return np.frombuffer(x["ids"], "<u4"), np.frombuffer(x["sizes"], "<i8"), found


_ROWS = "block int, part int, rows binary, weight binary, change binary"


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    """The changes of a block's rows, averaged by how many steps changed them."""
    total, weight = np.zeros((BLOCK, WIDTH + 1)), np.zeros(BLOCK)
    for x in rows.itertuples(index=False):
        at, w = np.frombuffer(x.rows, "<u2"), np.frombuffer(x.weight, "<f4").astype(float)
        total[at] += w[:, None] * np.frombuffer(x.change, "<f2").reshape(-1, WIDTH + 1)
        weight[at] += w
    at = np.flatnonzero(weight)
    return pd.DataFrame({"block": rows["block"].iloc[:1], "part": 0, "rows": [at.astype("<u2").tobytes()], "weight": [weight[at].astype("<f4").tobytes()], "change": [(total[at] / weight[at, None]).astype("<f2").tobytes()]})


def train(chunks: DataFrame, shared: Broadcast) -> Model:
    """The model after ROUNDS rounds that together see every token of the training documents once; shared holds the vocabulary."""
    spark, model = chunks.sparkSession, Model.start(shared.value)
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(model.matrix)

        def learn(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pd.DataFrame]:
            part, v, trainer = TaskContext.get().partitionId(), shared.value, None
            for batch in batches:
                for x in _each(batch):
                    if trainer is None:
                        trainer = Trainer(Model(v, now.value), 1000 * turn + part)
                    ids, sizes, (symbol, _, _) = _tokens(x, v)
                    train_ = np.frombuffer(x["held"], np.uint8) == 0
                    symbols, sizes = symbol[ids[np.repeat(train_, sizes)]], sizes[train_]
                    age = ages(len(symbols), np.cumsum(sizes) - sizes)
                    for i in range(0, len(symbols), BATCH):
                        trainer.learn(symbols, age, i, min(len(symbols), i + BATCH))
            if trainer is not None:
                rows = np.flatnonzero(trainer.touched)
                for own in np.split(rows, np.flatnonzero(np.diff(rows // BLOCK)) + 1):
                    if len(own):
                        change = np.clip(trainer.model.matrix[own] - now.value[own], -1000, 1000).astype("<f2").tobytes()
                        yield pa.RecordBatch.from_pydict({"block": pa.array([own[0] // BLOCK], pa.int32()), "part": pa.array([part % 64], pa.int32()), "rows": [(own % BLOCK).astype("<u2").tobytes()], "weight": [trainer.touched[own].tobytes()], "change": [change]})

        own = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == turn).select("held", "sizes", "ids", "words", "lengths")
        for r in own.mapInArrow(learn, _ROWS).groupBy("block", "part").applyInPandas(_mean, _ROWS).groupBy("block").applyInPandas(_mean, _ROWS).collect():
            model.matrix[r["block"] * BLOCK + np.frombuffer(r["rows"], "<u2").astype(np.int64)] += np.frombuffer(r["change"], "<f2").reshape(-1, WIDTH + 1)
        now.unpersist()
    return model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out, the others train; a null doc_id counts as an empty text.
    Null and empty texts are an end alone. Rows that share a doc_id are documents of their own. Other columns are left
    out. No rows: no rows; without training documents, N is 0 and no word is known. Texts are scored whole.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    chunks = stored(_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))), "chunks", rows=8)
    counts = stored(_counts(chunks), "counts")
    vocabulary = _vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    trained = spark.sparkContext.broadcast(train(chunks, shared).matrix)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        m, base = Model(v, trained.value), math.log10(v.total + v.distinct + 1)
        for batch in batches:
            for x in _each(batch):
                ids, sizes, (symbol, log, known) = _tokens(x, v)
                starts = np.cumsum(sizes) - sizes
                own = m.log10(symbol[ids], starts)
                rest = np.where(symbol < v.own, 0.0, log - v.group_log[np.maximum(symbol - v.own, 0)])
                far = np.flatnonzero(known[ids] < 0)  # words of each document that the head does not have, and how often
                pair, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[far] << 32 | ids[far], return_counts=True)
                edges = pa.array(np.searchsorted(pair, np.arange(len(sizes) + 1) << 32), pa.int32())
                words = _words(x["words"], np.frombuffer(x["lengths"], "<i4")).take(pa.array(pair & 0xFFFFFFFF))
                columns = {
                    "row": (x["chunk"] << 20) + np.arange(len(sizes)),
                    "doc_id": pa.array(np.frombuffer(x["doc_ids"], "<i8"), mask=np.frombuffer(x["nulls"], np.uint8) > 0),
                    "held_out": np.frombuffer(x["held"], np.uint8) > 0,
                    "n_tokens": sizes,
                    "n_known": np.add.reduceat((known > 0).astype(np.int64)[ids], starts),
                    "base_score": np.add.reduceat(log[ids], starts) - sizes * base,
                    "score": np.add.reduceat(own + rest[ids], starts),
                    "words": pa.ListArray.from_arrays(edges, words),
                    "counts": pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())),
                }
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<binary>, counts array<long>"
    first = stored(chunks.drop("counts").mapInArrow(measure, kind), "scores")
    rare = first.select("row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"))
    out = first.drop("words", "counts").join(rare, "row", "left")
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"))


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
