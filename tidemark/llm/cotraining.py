"""Quality and toxicity by co-training two views of a document.

The content view sees hashed words and character shares of the text; the metadata view sees the page's source, language,
length and layout. Each view is a logistic regression fitted to the labelled sample. In each round both views score every
document without a label; those that a view is sure of are training rows of the other view, with its verdict as their label.
They are too many to hold, so they enter by the slope and bend of their loss at the other view's weights, added up over all
documents; the view then goes on from there on its labelled rows and these sums. A view is sure by its own evidence, the odds
beyond the class's share, so that a view that knows nothing labels nothing. What a view learned in a round stays only if its
log loss on set-aside labels falls; at the end all documents are scored by the sum of the calibrated log odds.

Only the labelled side is a sample: FIT labelled documents at most, those with the least hashes of their ids. The exchange
and the scoring read every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.hashing import U, hashed_words, mixed

FIT = 12_000
CONTENT, META = 1 << 15, 1 << 10
WIDTHS = (CONTENT, META)
#: Rounds of exchange, and the probability, by a view's own evidence, from which on it is sure.
ROUNDS, SURE = 2, 0.95
#: What all pseudo-labelled rows weigh beside all labelled ones, and how much steeper than its diagonal their bend is taken.
TRUST, DAMPING = 0.3, 20.0
#: Features whose sums are added up together.
BLOCK = 4096
_DENSE = 8


def _shares(text: str) -> list[float]:
    """Character and word shares that junk and good prose differ in."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(data))
    count = np.bincount(data, minlength=256)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    symbols = sum(int(count[ord(c)]) for c in "#*$%&|<>")
    words = max(1, int(count[32] + count[10] + 1))
    return [1.0, symbols / n * 10, int(count[65:91].sum()) / max(1, letters) * 3, int(count[33]) / words, int(count[48:58].sum()) / n * 5, min(2.0, n / words / 6), letters / n, min(1.0, 20 / words)]


def features(frame: pd.DataFrame) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Content and metadata view of the rows of frame (text, source, lang): row, column and value of what is not zero."""
    texts = [t if isinstance(t, str) else "" for t in frame["text"]]
    word, row, _, _ = hashed_words(texts)
    column = (mixed(word, 4) >> U(49)).astype(np.int64) % (CONTENT - _DENSE) + _DENSE
    pair, n = np.unique(row * CONTENT + column, return_counts=True)
    rows, columns = pair // CONTENT, pair % CONTENT
    value = np.sqrt(n)  # a word counts for more in a short text
    value = value / np.sqrt(np.maximum(1e-9, np.bincount(rows, value**2, len(texts))))[rows] * 3
    dense = np.array([_shares(t) for t in texts]).reshape(-1, _DENSE)
    many = np.repeat(np.arange(len(texts)), _DENSE)
    content = np.concatenate([rows, many]), np.concatenate([columns, np.tile(np.arange(_DENSE), len(texts))]), np.concatenate([value, dense.ravel()])
    meta = []
    for i, (t, source, lang) in enumerate(zip(texts, frame["source"], frame["lang"], strict=True)):
        lines = t.count("\n") + 1
        size = len(t)
        said = [("bias",), ("source", source), ("lang", lang), ("size", size.bit_length()), ("lines", lines.bit_length()), ("line", (size // lines).bit_length())]
        meta += [(i, _column(x)) for x in said]
    at = np.array(meta, np.int64).reshape(-1, 2)
    return content, (at[:, 0], at[:, 1], np.ones(len(at)))


def _column(said: tuple) -> int:
    word, _, _, _ = hashed_words(["\x01".join(map(str, said))], np.zeros(256, bool) | (np.arange(256) == 32))
    return int(word[0] % np.uint64(META)) if len(word) else 0


class View:
    """A logistic regression on sparse rows."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, width: int):
        self.rows, self.columns, self.values, self.n, self.width = rows, columns, values, n, width
        self.weights = np.zeros(width)

    def scores(self) -> np.ndarray:
        return np.bincount(self.rows, self.values * self.weights[self.columns], self.n)

    def fit(self, target: np.ndarray, weight: np.ndarray, pull: tuple[np.ndarray, np.ndarray] | None = None, steps: int = 300, rate: float = 1.0, keep: float = 1e-4) -> None:
        """Full-batch AdaGrad on the rows with weight, with a small pull to zero. pull is the slope and bend, at the present
        weights, of the loss over rows that are not here; with it fitting goes on from these weights."""
        used = weight[self.rows] > 0
        rows, columns, values = self.rows[used], self.columns[used], self.values[used]
        weight = weight / weight.sum()
        before = self.weights if pull else np.zeros(self.width)
        weights, past = before.copy(), np.full(self.width, 1e-8)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * weights[columns], self.n), -30, 30)))
            slope = np.bincount(columns, values * (weight * (p - target))[rows], self.width) + keep * weights
            if pull:
                slope += pull[0] + pull[1] * (weights - before)
            past += slope**2
            weights -= rate * slope / np.sqrt(past)
        self.weights = weights


def _balanced(target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights under which both classes count the same."""
    out = weight.astype(float)
    for value in (0, 1):
        own = target == value
        out[own] *= 0.5 / max(1e-9, out[own].sum())
    return out


def _platt(scores: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """a and b for which 1 / (1 + exp(-(a * score + b))) fits target; a is not negative. Newton steps, slightly held back."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        g, h = np.array([((p - target) * scores).sum() + 0.01 * a, (p - target).sum()]), p * (1 - p) + 1e-6
        second = np.array([[(h * scores**2).sum() + 0.01, (h * scores).sum()], [(h * scores).sum(), h.sum()]])
        step = np.linalg.solve(second, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return (a, b) if a > 0 else (0.0, float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))))


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Goal:
    """What is fitted for one goal: views, calibration and the labelled share of ones. target is -1 where unknown; every fourth
    labelled row of a class is only for calibration. Without enough labels of both classes nothing is learned."""

    def __init__(self, views: list[View], target: np.ndarray):
        self.views, self.target = views, target
        known = np.flatnonzero(target >= 0)
        self.aside = np.sort(np.concatenate([np.flatnonzero(target == value)[::4] for value in (0, 1)]))
        train = np.setdiff1d(known, self.aside)
        self.share = float(np.clip(target[known].mean() if len(known) else 0.5, 1e-3, 1 - 1e-3))
        self.able = len(train) >= 10 and len(set(target[train].tolist())) == 2 and len(set(target[self.aside].tolist())) == 2
        self.weight = np.zeros(len(target))
        self.weight[train] = 1
        self.lines = [(0.0, float(np.log(self.share / (1 - self.share))))] * 2

    def fit(self) -> None:
        """Both views on the labelled rows alone."""
        if self.able:
            for i, v in enumerate(self.views):
                v.fit(self.target, _balanced(self.target, self.weight))
                self.lines[i] = self._line(v)

    def go_on(self, view: int, sums: np.ndarray) -> bool:
        """A round of one view with the pseudo-labelled rows that sums stand for; undone where it does not help. True if it stays."""
        told = pull(sums)
        if not self.able or told is None:
            return False
        v, before = self.views[view], (self.views[view].weights, self.lines[view], self._loss(view))
        v.fit(self.target, _balanced(self.target, self.weight), told, 150, 0.5)
        self.lines[view] = self._line(v)
        if self._loss(view) < before[2]:
            return True
        v.weights, self.lines[view] = before[:2]
        return False

    def _line(self, view: View) -> tuple[float, float]:
        return _platt(view.scores()[self.aside], self.target[self.aside])

    def _loss(self, view: int) -> float:
        (a, b), known = self.lines[view], self.target[self.aside]
        return float(np.mean(np.logaddexp(0, (1 - 2 * known) * (a * self.views[view].scores()[self.aside] + b))))

    def learned(self) -> tuple[list[np.ndarray], list[tuple[float, float]], float, bool]:
        return [v.weights for v in self.views], self.lines, self.share, self.able


def pull(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Slope and bend of the loss over pseudo-labelled rows, both classes counting the same, from exchanged sums; None without rows of both."""
    n = sums[:, 0, -1]
    if not n.all():
        return None
    slope, bend = TRUST * np.mean(sums[:, :, :-1] / n[:, None, None], axis=0)
    return slope, DAMPING * bend


def sure_sums(frame: pd.DataFrame, learned: dict, labelled: np.ndarray) -> dict[tuple[str, int], np.ndarray]:
    """For each goal and view, over the documents of frame that the other view is sure of: by class, the slope and the bend of
    this view's logistic loss at its weights, with the number of documents at the end of both. Labelled documents give none."""
    both, out = features(frame), {}
    fresh = ~np.isin(_numbers(frame["doc_id"]), labelled)
    for goal, (weights, lines, share, able) in learned.items():
        if not able:
            continue
        scores = [np.bincount(rows, values * w[columns], len(frame)) for (rows, columns, values), w in zip(both, weights, strict=True)]
        for me in (0, 1):
            (rows, columns, values), width = both[me], WIDTHS[me]
            a, b = lines[1 - me]
            told, p = _probability(a * scores[1 - me] + b - np.log(share / (1 - share))), _probability(scores[me])
            sums = np.zeros((2, 2, width + 1))
            for value, sure in enumerate((1 - told >= SURE, told >= SURE)):
                on = (fresh & sure).astype(float)
                sums[value, 0, :-1] = np.bincount(columns, values * (on * (p - value))[rows], width)
                sums[value, 1, :-1] = np.bincount(columns, values**2 * (on * np.maximum(p * (1 - p), 0.02))[rows], width)
                sums[value, :, -1] = on.sum()
            out[goal, me] = sums
    return out


def _numbers(ids: pd.Series) -> np.ndarray:
    return np.array([-1 if pd.isna(x) else int(x) for x in ids.astype(object)], np.int64)


def _slices(frames: Iterator[pd.DataFrame], size: int = 2_000_000) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            lengths = frame["text"].str.len().fillna(0).to_numpy(float)
            for _, part in frame.groupby(np.cumsum(lengths) // size, sort=False):
                yield part


_SUMS = "goal string, view int, block int, part int, sums binary"


def exchanged(docs: DataFrame, learned: dict, labelled: np.ndarray) -> dict[tuple[str, int], np.ndarray]:
    """sure_sums over all docs: added up in tasks, then by block of features in two steps."""
    shared = docs.sparkSession.sparkContext.broadcast((learned, labelled))

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for part in _slices(frames):
            for key, sums in sure_sums(part, *shared.value).items():
                total[key] = total[key] + sums if key in total else sums
        own = TaskContext.get().partitionId() % 64
        out = [(goal, view, at // BLOCK, own, sums[:, :, at : at + BLOCK].astype("<f8").tobytes()) for (goal, view), sums in total.items() for at in range(0, sums.shape[2], BLOCK)]
        yield pd.DataFrame(out, columns=["goal", "view", "block", "part", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<f8") for x in rows["sums"])
        return rows.iloc[:1].assign(part=0, sums=[total.tobytes()])

    keys = ["goal", "view", "block"]
    found = docs.mapInPandas(collect, _SUMS).groupBy(*keys, "part").applyInPandas(add, _SUMS).groupBy(*keys).applyInPandas(add, _SUMS).collect()
    out = {(goal, view): np.zeros((2, 2, WIDTHS[view] + 1)) for goal in learned for view in (0, 1)}
    for r in found:
        sums = np.frombuffer(r["sums"], "<f8").reshape(2, 2, -1)
        out[r["goal"], r["view"]][:, :, r["block"] * BLOCK : r["block"] * BLOCK + sums.shape[2]] = sums
    return out


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows to fit on: bounded by FIT, whatever the tables' sizes."""
    labels = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.join(F.broadcast(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT)), "doc_id")


def _plain(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns that count, in one type each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return docs, labels


def learn(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> dict:
    """What each goal's views have learned, by goal: weights, calibration, share of ones, and whether there were labels enough.
    Without rounds the labels alone count."""
    docs, labels = _plain(docs, labels)

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = features(frame)
            out = {"doc_id": frame["doc_id"], "quality": frame["quality"].astype("Int64"), "toxic": frame["toxic"].astype("Int64")}
            for name, (rows, columns, values) in zip(("content", "meta"), both, strict=True):
                order = np.argsort(rows, kind="stable")
                ends = np.searchsorted(rows[order], np.arange(1, len(frame) + 1))
                out[f"{name}_at"] = [x.astype("<i4").tobytes() for x in np.split(columns[order], ends[:-1])]
                out[f"{name}_value"] = [x.astype("<f4").tobytes() for x in np.split(values[order], ends[:-1])]
            yield pd.DataFrame(out)

    kind = "doc_id long, quality int, toxic int, content_at binary, content_value binary, meta_at binary, meta_value binary"
    sample = stored(_sampled(docs, labels).mapInPandas(extract, kind), "sample").orderBy("doc_id", "content_at").toPandas()
    sides = []  # rows, columns and values of each view, which both goals share
    for name in ("content", "meta"):
        at, value = sample.pop(f"{name}_at"), sample.pop(f"{name}_value")
        rows = np.repeat(np.arange(len(sample), dtype=np.int32), [len(x) // 4 for x in at])
        sides.append((rows, np.frombuffer(b"".join(at), "<i4"), np.frombuffer(b"".join(value), "<f4").astype(float)))
    goals = {}
    for goal in ("quality", "toxic"):
        goals[goal] = Goal([View(*side, len(sample), width) for side, width in zip(sides, WIDTHS, strict=True)], sample[goal].fillna(-1).to_numpy(int))
        goals[goal].fit()
    labelled = np.unique(sample["doc_id"].to_numpy(np.int64))
    for _ in range(rounds if any(g.able for g in goals.values()) else 0):
        found = exchanged(docs, {k: g.learned() for k, g in goals.items()}, labelled)
        if not sum(goals[goal].go_on(view, sums) for (goal, view), sums in found.items()):
            break  # the next round would be the same
    return {k: g.learned() for k, g in goals.items()}


def classified(docs: DataFrame, labels: DataFrame, keep: float = 0.5) -> DataFrame:
    """doc_id, quality, toxic (probabilities) and kept for each row of docs (doc_id, text, source, lang).

    kept: quality of at least keep and toxic below a half. labels has doc_id, quality and toxic (0 or 1); labels that contradict
    each other count as 1; a null says nothing on its goal. With too few labels of one class the labelled share stands for every
    document. Null texts count as empty and null sources or languages as a value of their own. Rows that share a doc_id are
    scored one by one; a null doc_id stays null. Other columns are left out. No rows: no rows.
    """
    docs, labels = _plain(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def classify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(frames):
            both, out = features(part), {"doc_id": part["doc_id"].astype("Int64").to_numpy()}
            for goal, (weights, lines, share, _) in shared.value.items():
                odds = np.full(len(part), -np.log(share / (1 - share)))  # each view counts the prior once
                for (rows, columns, values), w, (a, b) in zip(both, weights, lines, strict=True):
                    odds += a * np.bincount(rows, values * w[columns], len(part)) + b
                out[goal] = _probability(odds)
            yield pd.DataFrame(out)

    scored = docs.mapInPandas(classify, "doc_id long, quality double, toxic double")
    return scored.withColumn("kept", (F.col("quality") >= keep) & (F.col("toxic") < 0.5))


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
