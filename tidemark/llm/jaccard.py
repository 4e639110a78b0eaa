"""Near-duplicate groups by an exact Jaccard join over word shingles.

1. Each text becomes a set of shingle hashes; equal sets are one set from the start. All sets share one inverted index, dealt out by
   ranges of the hash, which tells how often each shingle occurs. A set of which too few shingles occur elsewhere is linked with nothing.
2. Of the other sets the rarest shingles, in one order for all sets, are looked up in their short inverted lists: linked sets overlap so
   much that they share one among these. Lists of common shingles are never read for candidates.
3. Where sets meet in a list, each is compared with leaders of its list. A T-occurrence search (DivideSkip) takes the leader as query over
   inverted lists of up to 256 members: short lists are merged by a heap, long ones probed by bisection, and members
   with the overlap that their size needs are linked.
4. Links join sets into components. Where members of one list are still apart, they are compared with a leader of the largest component and
   one of another; and at last those outside the largest component are paired with all of the list whose sizes and places in the
   order still allow the overlap, and searched too, so no link is lost; within a component further links change nothing.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.hashing import STEP, U, hashed_words, mixed

#: Words of a shingle, and percent of similarity from which sets link.
WORDS, NEAR = 5, 80
#: Bytes of text for each bucket of sets and shingles, whose rows come together in one task.
BUCKET_BYTES = 4_000_000
#: Copies of the labels that many nodes share, in the join that follows them.
SALT = 16
#: Members that one search indexes, and pairs whose searches share a task's group.
CHUNK, PACK = 256, 1000
#: Rows of two numbers that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
LAST = np.iinfo(np.int64).max


def shingle_sets(texts: Sequence[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other; and where each text's end.

    Words are runs of other bytes than space and control white space, with A-Z in lower case. A text with
    fewer words than a shingle is one shingle; one without words has none.
    """
    word, text, _, _ = hashed_words(texts)
    n_words = np.bincount(text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)])
    # A shingle starts at each word with enough words after it in its text, or at the first word of a short text.
    left = first[text + 1] - np.arange(len(word))
    start = np.flatnonzero((left >= words) | ((n_words[text] < words) & (left == n_words[text])))
    value = np.zeros(len(start), U)
    for k in range(words):
        more = k < left[start]
        value = np.where(more, mixed(value * STEP[4] + word[np.minimum(start + k, len(word) - 1)], 1), value) if len(word) else value
    owner = text[start]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
        value, owner = value[new], owner[new]
    return value, np.cumsum(np.bincount(owner, minlength=len(texts)))


def set_keys(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits that stand for a set: 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(values, 7))])
    begins = np.concatenate([[0], ends[:-1]])
    return np.where(ends > begins, mixed(sums[ends] - sums[begins] + (ends - begins).astype(U) * STEP[10], 8), U(0)).astype(np.int64)


def slots_of(sizes: np.ndarray) -> np.ndarray:
    """Bytes of the sketch of a set: a power of two, from 0.4 of its size up."""
    return 1 << np.ceil(np.log2(np.maximum(16, 0.4 * np.asarray(sizes)))).astype(np.int64)


def sketches(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each set a byte for each of slots_of ranges of the hashes: the sum over the range's elements of a byte of each.

    Bytes that differ come from elements that differ, so sets with more unlike bytes than linked sets have unlike elements
    are not linked. Neighbouring bytes add up to those of a sketch of half as many ranges.
    """
    sizes = np.diff(np.concatenate([[0], ends]))
    slots = slots_of(sizes)
    until = np.cumsum(slots)
    owner = np.repeat(np.arange(len(ends)), sizes)
    shift = (64 - np.log2(slots).astype(np.int64)).astype(U)
    at = (until - slots)[owner] + (values >> shift[owner]).astype(np.int64)
    sums = np.bincount(at, (mixed(values, 9) >> U(56)).astype(float), int(slots.sum())).astype(np.int64).astype(np.uint8).tobytes()
    return [sums[i:j] for i, j in zip((until - slots).tolist(), until.tolist(), strict=True)]


def parities(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set WORDS_OF_BITS words of 64 bits: the parity of its elements at each of the bits. Bits that differ come from elements that
    differ, so two sets have at least as many unlike elements as unlike bits."""
    n, begins = 64 * WORDS_OF_BITS, np.concatenate([[0], ends])
    bit, out = (mixed(values, 4) % U(n)).astype(np.int64), np.empty((len(ends), n // 8), np.uint8)
    for a in range(0, len(ends), 1000):  # a thousand sets at a time, as each takes a counter for each bit
        own = begins[a : a + 1001]
        owner = np.repeat(np.arange(len(own) - 1), np.diff(own))
        odd = np.bincount(owner * n + bit[own[0] : own[-1]], minlength=(len(own) - 1) * n) & 1
        out[a : a + 1000] = np.packbits(odd.astype(np.uint8)).reshape(-1, n // 8)
    return out.view("<i8")


def may_link(one: Sequence[bytes], sizes: np.ndarray, other: Sequence[bytes], others: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Which pairs of sets, given by sketches and sizes, could be linked."""
    out = np.minimum(sizes, others) * 100 >= near * np.maximum(sizes, others)
    most = (sizes + others) * (100 - near) // (100 + near)
    a, b = slots_of(sizes), slots_of(others)
    for x, y in set(zip(a[out].tolist(), b[out].tolist(), strict=True)):
        at = np.flatnonzero(out & (a == x) & (b == y))
        left, right = (np.frombuffer(b"".join([s[i] for i in at.tolist()]), np.uint8).reshape(-1, n) for s, n in ((one, x), (other, y)))
        while left.shape[1] > y:
            left = left[:, ::2] + left[:, 1::2]
        while right.shape[1] > x:
            right = right[:, ::2] + right[:, 1::2]
        out[at] = (left != right).sum(axis=1) <= most[at]
    return out


def t_occurrence(lists: list[np.ndarray], least: int, mu: float = 0.01) -> dict[int, int]:
    """Ids in at least `least` of the ascending lists, with the number of lists: DivideSkip.

    The longest lists are set apart, the fewer the longer they are; an id in enough of the lists has to be in the
    short ones so often that few ids remain to be looked up in the long ones.
    """
    lists = sorted(lists, key=len, reverse=True)
    if len(lists) < least or not lists:
        return {}
    apart = min(least - 1, int(least / (mu * math.log2(len(lists[0]) + 1) + 1)))
    long = [x.tolist() for x in lists[:apart]]
    found = {}
    for one, same in groupby(heapq.merge(*(x.tolist() for x in lists[apart:]))):
        n = sum(1 for _ in same)
        if n < least - apart:
            continue
        for k, x in enumerate(long):
            if n + len(long) - k < least:
                break
            at = bisect_left(x, one)
            n += at < len(x) and x[at] == one
        else:
            if n >= least:
                found[one] = n
    return found


def linked(query: np.ndarray, members: list[np.ndarray], near: int = NEAR) -> list[int]:
    """Numbers of the members whose Jaccard similarity with query is near percent or more."""
    need = [-(-near * (len(query) + len(m)) // (100 + near)) for m in members]
    able = [i for i, m in enumerate(members) if need[i] <= min(len(query), len(m))]
    if not able:
        return []
    # The inverted lists: for each shingle hash, the members that have it, ascending.
    values, owner = np.concatenate([members[i] for i in able]), np.repeat(able, [len(members[i]) for i in able])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    a, b = np.searchsorted(values, query), np.searchsorted(values, query, side="right")
    found = t_occurrence([owner[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j], max(1, min(need[i] for i in able)))
    return [i for i, n in found.items() if n >= need[i]]


def _batches(frames: Iterator[pd.DataFrame], size: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Frames of texts cut so that none is much longer than size, unless one text is, and none has more than ROWS rows."""
    for frame in frames:
        if len(frame):
            lengths = frame["text"].str.len().fillna(0).to_numpy()
            cut = np.cumsum(lengths) // size * (len(frame) // ROWS + 1) + np.arange(len(frame)) // ROWS
            for _, part in frame.groupby(cut, sort=False):
                yield part


def _ids(column: pd.Series) -> np.ndarray:
    return np.array([LAST if pd.isna(x) else int(x) for x in column.astype(object)], np.int64)


#: Texts of a batch at most: the numbers of its sets take two bytes.
ROWS = 60_000
#: Words of 64 parity bits that a set is compared by where pairs are made.
WORDS_OF_BITS = 16
#: Bytes of a posting's hash; with its bucket it stands for the shingle.
LOW = 5


def _low(values: np.ndarray) -> bytes:
    """The low LOW bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :LOW].tobytes()


def _from_low(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // LOW, 8), np.uint8)
    out[:, :LOW] = np.frombuffer(data, np.uint8).reshape(-1, LOW)
    return out.view("<u8").ravel()


def _sent(docs: DataFrame, buckets: int, words: int) -> DataFrame:
    """For each bucket: distinct sets with their least document, names of batches, and the postings of a batch, ascending: shingles
    and the set's number in the batch."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _batches(frames):
            values, ends = shingle_sets(frame["text"].tolist(), words)
            keys, ids, sizes = set_keys(values, ends), _ids(frame["doc_id"]), np.diff(np.concatenate([[0], ends]))
            order = np.lexsort((ids, keys))
            one = order[np.concatenate([[True], np.diff(keys[order]) != 0])]
            one = one[sizes[one] > 0]
            number = np.full(len(keys), -1)
            number[one] = np.arange(len(one))
            owner = number[np.repeat(np.arange(len(ends)), sizes)]
            value, owner = values[owner >= 0], owner[owner >= 0]
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            batch = int(mixed(np.array([np.sum(mixed(keys.astype(U), 2) + mixed(ids.astype(U), 10))], U))[0].astype(np.int64))
            sketch = sketches(values, ends)
            home = (mixed(keys[one].astype(U)) % U(buckets)).astype(np.int64)
            at = np.argsort(home, kind="stable")
            a = np.searchsorted(home[at], np.arange(buckets + 1))
            b = np.searchsorted(((value >> U(32)) * U(buckets) >> U(32)).astype(np.int64), np.arange(buckets + 1))
            bits = parities(values, ends)
            low, numbers, own, out = _low(value), owner.astype("<u2").tobytes(), batch % buckets, []
            names = np.stack([keys[one], sizes[one]]).astype("<i8").tobytes()
            for k in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0) | (np.arange(buckets) == own)).tolist():
                s, i, j = one[at[a[k] : a[k + 1]]], int(b[k]), int(b[k + 1])
                out.append((k, batch, names if k == own else b"", np.stack([keys[s], ids[s], sizes[s]]).astype("<i8").tobytes(), b"".join([sketch[x] for x in s.tolist()]), bits[s].tobytes(), low[LOW * i : LOW * j], numbers[2 * i : 2 * j]))
            yield pd.DataFrame(out, columns=["bucket", "batch", "names", "sets", "sketches", "bits", "low", "numbers"])

    return docs.mapInPandas(send, "bucket int, batch long, names binary, sets binary, sketches binary, bits binary, low binary, numbers binary")


_COUNTED = "kind int, key long, doc_id long, size long, sketch binary, bits array<long>, batch long, names binary, bucket int, low binary, numbers binary, often binary"


def _counted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket. Kind 0: each set with its least document, size and sketch. Kind 1: a batch's names and its postings of shingles
    that occur more than once, with an ascending step of how often."""
    (bucket,) = key
    sets = np.concatenate([np.frombuffer(x, "<i8").reshape(3, -1) for x in frame["sets"]], axis=1)
    bits = np.frombuffer(b"".join(frame["bits"]), "<i8").reshape(-1, WORDS_OF_BITS)
    until = np.cumsum(slots_of(sets[2]))
    sketch, begin = b"".join(frame["sketches"]), until - slots_of(sets[2])
    order = np.lexsort((sets[1], sets[0]))
    one = order[np.concatenate([[True], np.diff(sets[0][order]) != 0])] if len(order) else order
    frame = frame.drop_duplicates("batch")  # batches of one number have the same rows
    low, counts = _from_low(b"".join(frame["low"])), [len(x) // LOW for x in frame["low"]]
    order = np.argsort(low, kind="stable")
    run = np.cumsum(np.concatenate([[True], np.diff(low[order]) != 0])[: len(order)]) - 1
    often = np.empty(len(low), np.int64)
    often[order] = np.bincount(run)[run] if len(run) else run
    step = np.floor(np.log2(np.maximum(often, 1)) * 1024).astype("<u2")
    numbers, ends = np.frombuffer(b"".join(frame["numbers"]), "<u2"), np.cumsum(counts).tolist()
    out = []
    for batch, names, i, j in zip(frame["batch"], frame["names"], [0, *ends[:-1]], ends, strict=True):
        at = np.flatnonzero(often[i:j] > 1) + i
        if len(at) or names:
            out.append((batch, names, int(bucket), _low(low[at]), numbers[at].tobytes(), step[at].tobytes()))
    a = pd.DataFrame({"kind": 0, "key": sets[0][one], "doc_id": sets[1][one], "size": sets[2][one], "sketch": [sketch[i:j] for i, j in zip(begin[one].tolist(), until[one].tolist(), strict=True)], "bits": list(bits[one]), **dict.fromkeys(("batch", "names", "bucket", "low", "numbers", "often"))})
    b = pd.DataFrame(out, columns=["batch", "names", "bucket", "low", "numbers", "often"]).assign(kind=1, key=None, doc_id=None, size=None, sketch=None, bits=None)
    whole = dict.fromkeys(("key", "doc_id", "size", "batch", "bucket"), "Int64")
    return pd.concat([a.astype(whole), b.astype(whole)])[[c.split()[0] for c in _COUNTED.split(", ")]]


def _rarest(near: int):
    """Of one batch: for each set that may be linked, the shingles among its rarest that others have, with their place in the order of the
    whole set, and whether sets of its size or larger would meet it there."""

    def rarest(frame: pd.DataFrame) -> pd.DataFrame:
        names = next(x for x in frame["names"] if x)
        keys, sizes = np.frombuffer(names, "<i8").reshape(2, -1)
        low, number = _from_low(b"".join(frame["low"])), np.frombuffer(b"".join(frame["numbers"]), "<u2").astype(np.int64)
        often = np.frombuffer(b"".join(frame["often"]), "<u2").astype(np.int64)
        bucket = np.repeat(frame["bucket"].to_numpy(np.int64), [len(x) // LOW for x in frame["low"]])
        shared = np.bincount(number, minlength=len(keys))
        able = shared >= (near * sizes + 99) // 100  # a linked set has so many of its shingles
        kept = able[number]
        low, number, often, bucket = low[kept], number[kept], often[kept], bucket[kept]
        shingle = mixed(low ^ (bucket.astype(U) << U(40)), 5)
        order = np.lexsort((shingle, often, number))
        number, shingle = number[order], shingle[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(keys)))])
        place = np.arange(len(number)) - first[number] + (sizes - shared)[number]  # those that none else has come first
        size = sizes[number]
        inside = place <= size - (near * size + 99) // 100
        small = place <= size - (2 * near * size + 99 + near) // (100 + near)
        return pd.DataFrame({"shingle": shingle.astype(np.int64), "key": keys[number], "size": size, "place": place, "small": small})[inside]

    return rarest


def _index(docs: DataFrame, words: int, near: int) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (key, start, size, sketch, bits), and the inverted lists of rare shingles (shingle, key, size, place, small)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = stored(_sent(docs, max(parts * 4, held // BUCKET_BYTES), words).groupBy("bucket").applyInPandas(_counted, _COUNTED), "counted")
    nodes = found.where("kind = 0").select("key", F.col("doc_id").alias("start"), "size", "sketch", "bits")
    rows = found.where("kind = 1").select("batch", "names", "bucket", "low", "numbers", "often")
    lists = rows.groupBy("batch").applyInPandas(_rarest(near), "shingle long, key long, size long, place long, small boolean")
    return nodes, stored(lists.dropDuplicates(["shingle", "key"]), "lists")


def _led(lists: DataFrame) -> DataFrame:
    """Each member of a list with its two leaders: the sets that come first in two fixed random orders. In a list in which no set is small
    nothing has to meet."""
    first = lists.groupBy("shingle").agg(*(F.min_by("key", F.xxhash64("key", F.lit(k))).alias(f"l{k}") for k in (0, 1)), F.count("*").alias("n"), F.bool_or("small").alias("small")).where("n > 1 AND small").drop("small")
    pairs = lists.select("shingle", F.col("key").alias("member")).join(first, "shingle").select(F.explode(F.array("l0", "l1")).alias("leader"), "member")
    return pairs.where("leader <> member").distinct()


def _promising(pairs: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """The pairs (leader, member) that sizes and sketches do not rule out."""
    a, b = (sets.select(F.col("key").alias(k), F.col("size").alias(f"{k}_size"), F.col("sketch").alias(f"{k}_sketch")) for k in ("leader", "member"))

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                able = may_link(frame["leader_sketch"].tolist(), frame["leader_size"].to_numpy(), frame["member_sketch"].tolist(), frame["member_size"].to_numpy(), near)
                yield frame.loc[able, ["leader", "member"]]

    return pairs.join(a, "leader").join(b, "member").mapInPandas(pick, "leader long, member long")


def _searched(tasks: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """Of the pairs (leader, member), those that are linked. Members of one leader are dealt out over searches of CHUNK."""
    counts = tasks.groupBy("leader").agg(F.count("*").alias("n"))
    packs = max(1, tasks.count() // PACK)
    dealt = tasks.join(counts, "leader").withColumn("deal", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / CHUNK)).cast("int")).drop("n")
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("leader", "deal"), F.lit(packs)))
    members = dealt.join(sets.select(F.col("key").alias("member"), F.col("shingles").alias("own")), "member")
    queries = dealt.select(F.col("pack").alias("of"), F.col("leader").alias("query"), F.col("deal").alias("part")).distinct().join(sets.select(F.col("key").alias("query"), "shingles"), "query")

    def search(query: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        own, out = {}, []
        for leader, deal, member, shingles in zip(rows["leader"], rows["deal"], rows["member"], rows["own"], strict=True):
            names, sets_ = own.setdefault((leader, deal), ([], []))
            names.append(member)
            sets_.append(np.frombuffer(shingles, "<u8"))
        for leader, deal, shingles in zip(query["query"], query["part"], query["shingles"], strict=True):
            names, sets_ = own.get((leader, deal), ([], []))
            out += [(leader, names[i]) for i in linked(np.frombuffer(shingles, "<u8"), sets_, near)]
        return pd.DataFrame(out, columns=["leader", "member"]).astype("int64")

    return queries.groupBy("of").cogroup(members.groupBy("pack")).applyInPandas(search, "leader long, member long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key, label and root for nodes (key, start) and links (leader, member): the least start that links lead to, and its key.

    A label is a start with its key. In each round a node takes the least label of its neighbours, then the label of
    the node that its label names, so that long chains take few rounds; labels are written to the shared folder.
    """
    labels = stored(nodes.select("key", F.struct("start", "key").alias("label")), "labels")
    both = stored(links.union(links.select("member", "leader")).distinct(), "links").toDF("from", "to")
    while True:
        got = both.join(labels, F.col("from") == F.col("key")).groupBy("to").agg(F.min("label").alias("other"))
        nearer = labels.join(got, F.col("key") == F.col("to"), "left").select("key", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        # Nodes of a large component name one node: they are dealt out over copies of its row.
        nearer = nearer.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(SALT)))
        roots = nearer.select(F.col("label.key").alias("key")).distinct()
        named = labels.join(roots, "key", "left_semi").select(F.col("key").alias("name"), F.col("label").alias("beyond"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")).alias("of"))
        after = stored(nearer.join(named, (F.col("label.key") == F.col("name")) & (F.col("deal") == F.col("of"))).select("key", "was", F.least("label", "beyond").alias("label")), "labels")
        labels = after.select("key", "label")
        if not after.where("label < was").count():
            return labels.select("key", F.col("label.start").alias("label"), F.col("label.key").alias("root"))


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of lists whose sets lie in different components, with root and most, the list's largest component."""
    rows = lists.join(labels.select("key", "root"), "key")
    counts = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.bool_or("small").alias("small"))
    counts = counts.groupBy("shingle").agg(F.count("*").alias("components"), F.bool_or("small").alias("any"), F.max_by("root", F.struct("n", "root")).alias("most"))
    return stored(rows.join(counts.where("components > 1 AND any").drop("components", "any"), "shingle"), "open")


def _closer(rows: DataFrame) -> DataFrame:
    """Members of open lists with a leader of their list's largest component and with one of another, which each list chooses by itself: a
    set in many lists meets many of a group of near copies, which so comes together before pairs are made in it."""
    some, beside = F.xxhash64("key", "shingle"), rows.where("root <> most")
    main = rows.where("root = most").groupBy("shingle").agg(F.min_by("key", some).alias("leader"))
    other = beside.groupBy("shingle").agg(F.min_by(F.struct("key", "root"), some).alias("of"))
    pairs = beside.join(main, "shingle").select("leader", F.col("key").alias("member"))
    pairs = pairs.unionByName(rows.join(other, "shingle").where(F.col("root") != F.col("of.root")).select(F.col("of.key").alias("leader"), F.col("key").alias("member")))
    return pairs.select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member")).distinct()


def _apart(rows: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """Pairs of sets of open lists that lie in different components and may be linked by their sizes, places and parity bits.

    In each list the sets that are small there are paired with those of their size or larger, but not those of the list's largest component
    with each other: copies and near copies of one component make no pairs.
    """
    def named(frame: DataFrame, x: str) -> DataFrame:
        return frame.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "size", "place", "root", "bits")))

    rows = rows.join(sets.select("key", "bits"), "key")
    small, beside = rows.where("small"), rows.where("root <> most")
    pairs = named(small.where("root <> most"), "a").join(named(rows, "b"), "shingle").unionByName(named(small.where("root = most"), "a").join(named(beside, "b"), "shingle"))
    fits = (F.col("size_a") <= F.col("size_b")) & (F.col("size_a") * 100 >= F.col("size_b") * near)
    room = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= F.ceil((F.col("size_a") + F.col("size_b")) * near / (100 + near))
    unlike = F.expr("aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    alike = unlike <= F.floor((F.col("size_a") + F.col("size_b")) * (100 - near) / (100 + near))
    pairs = pairs.where((F.col("root_a") != F.col("root_b")) & fits & room & alike)
    return pairs.select(F.least("key_a", "key_b").alias("leader"), F.greatest("key_a", "key_b").alias("member")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("leader").alias("key")).union(pairs.select("member")).distinct()


def _links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, near: int) -> DataFrame:
    """The linked ones of pairs, for which the texts of their sets' least documents are read again."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _batches(frames):
            values, ends = shingle_sets(frame["text"].tolist(), words)
            same = set_keys(values, ends) == frame["key"].to_numpy()
            begins = np.concatenate([[0], ends[:-1]])
            out = [(k, values[i:j].astype("<u8").tobytes()) for k, i, j, s in zip(frame["key"], begins, ends, same, strict=True) if s]
            yield pd.DataFrame(out, columns=["key", "shingles"])

    wanted = nodes.select("key", F.col("start").alias("doc_id")).join(_ends(pairs), "key", "left_semi")
    wanted = stored(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    named = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(LAST))))
    sets = stored(named.join(wanted, "doc_id").mapInPandas(read, "key long, shingles binary").dropDuplicates(["key"]), "sets")
    return stored(_searched(pairs, sets, near), "links")


def near_groups(docs: DataFrame, words: int = WORDS, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text): sets of shingles of so many words link when their
    Jaccard similarity is near percent or more.

    component_id is the least doc_id that links lead to, itself included. Null texts and texts without words have no shingles and
    no links. A null doc_id counts as larger than all, and a component of only such has a null component_id. Rows that share
    a doc_id are documents of their own. Other columns are left out. No rows: no rows.
    Sets are told apart by 64-bit hashes of their shingles, and shingles by theirs.
    """
    return _grouped(docs, words, near).select("doc_id", "n_shingles", F.nullif(F.coalesce("component", "doc_id"), F.lit(int(LAST))).alias("component_id"))


def _grouped(docs: DataFrame, words: int, near: int) -> DataFrame:
    """doc_id, n_shingles, the text's hash, and its component's least doc_id (LAST for null) and root; null without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes, lists = _index(docs, words, near)
    tasks = stored(_led(lists), "tasks")
    met = nodes.select("key", "start").join(_ends(tasks), "key", "left_semi")
    links = _links(docs, stored(_promising(tasks, nodes, near), "tasks"), nodes, words, near)
    labels = components(met, links)
    for search in (_closer, lambda rows: _apart(rows, nodes, near)):
        more = search(_open(lists, labels))
        for known in (tasks, tasks.toDF("member", "leader")):
            more = more.join(known, ["leader", "member"], "left_anti")
        more = stored(more, "tasks")
        able = stored(_promising(more, nodes, near), "tasks")
        if not able.isEmpty():
            links = links.union(_links(docs, able, nodes, words, near))
            labels = components(met, links)
        tasks = tasks.union(more)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _batches(frames):
            values, ends = shingle_sets(frame["text"].tolist(), words)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_shingles": np.diff(np.concatenate([[0], ends])), "key": set_keys(values, ends), "text_hash": frame["text_hash"]})

    counts = docs.withColumn("text_hash", F.xxhash64("text")).mapInPandas(counted, "doc_id long, n_shingles long, key long, text_hash long")
    # Written, so that the last join has a shuffle on each side: Spark then splits the rows of many equal texts.
    heads = stored(nodes.select("key", "start").join(labels, "key", "left").select("key", F.coalesce("label", "start").alias("component"), F.coalesce("root", "key").alias("root")), "heads")
    return counts.join(heads, "key", "left").select("doc_id", "n_shingles", "text_hash", "component", "root")


def one_of_each(docs: DataFrame, words: int = WORDS, near: int = NEAR) -> DataFrame:
    """docs with one document of each component: that of the least doc_id (null is larger than all), of those that share it the one
    with the least hash of its text, and of rows with equal doc_id and text one. Texts without words stay.

    Rows are named by doc_id and a 64-bit hash of the text, so rows with null or repeated doc_ids are judged one by one.
    """
    rows = _grouped(docs, words, near).select(F.coalesce("doc_id", F.lit(int(LAST))).alias("__id"), F.col("text_hash").alias("__hash"), "root")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("__id", "__hash")).alias("first")).select("first.*")
    stay = first.unionByName(rows.where("root IS NULL").select("__id", "__hash").distinct())
    here = (F.coalesce(docs["doc_id"].cast("long"), F.lit(int(LAST))) == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    return docs.join(stay, here, "left_semi").dropDuplicates(["doc_id", "text"])


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3, near=90)
