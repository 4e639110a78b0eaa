"""Each operator on small tables: against brute force, and with nulls, empty and long texts, ties, repeats, no rows and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from tidemark.llm import cotraining, hashing, jaccard, licenses, mixing, packing, repeats, rules, scoring, token_files, tokens, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone walks under bright morning glass table seven quiet horses run over green hill because nobody asked them why".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = " ".join(prose(1000 + i, 100) for i in range(60))
    shared = prose(77, 40)
    out = [(i, prose(i), "en", f"s{i % 3}", None) for i in range(12)]
    out += [(20, prose(3), "en", "s0", 1), (21, prose(3) + " end", None, None, 2), (22, "Start " + prose(4), "de", "s1", 3)]
    out += [(30, prose(30) + "\n" + shared, "en", "s0", 4), (31, prose(31) + "\n" + shared + "\n" + prose(32), "en", "s9", 5)]
    out += [(40, None, "en", "s0", 6), (41, "", "en", None, 7), (42, " \n\t ", "en", "s1", 8), (43, "One two", "en", "s1", 9), (44, "one TWO", "en", "s1", 9)]
    out += [(50, long, "en", "s2", 10), (51, "é日本 " * 40, "en", "s2", 11), (7, prose(7), "en", "s1", 12), (None, prose(5), "en", "s0", 13)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS size", "2 AS n", "'x' AS key", "3 AS bucket", "4 AS start").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def split(text):
    return (text or "").encode().lower().split()


def test_every_operator_has_a_query():
    assert sum(n.startswith("op") for n in __spark_entry__.queries()) == 13


# packing


def test_plan_uses_every_piece_and_fits():
    r = random.Random(1)
    for _ in range(20):
        counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(15)}
        used = Counter()
        for filling, windows in packing.plan_windows(counts, 64):
            assert sum(k * n for k, n in filling.items()) <= 64
            for k, n in filling.items():
                used[k] += n * windows
        assert used == counts


def test_fullest_is_the_best_subset():
    r = random.Random(2)
    for _ in range(50):
        items = [r.randint(1, 30) for _ in range(8)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= 50}
        chosen = packing.fullest(dict(Counter(items)), 50)
        assert sum(k * n for k, n in chosen.items()) == max(sums)
        assert all(n <= Counter(items)[k] for k, n in chosen.items())


def test_packed_sequences(docs, rows):
    code = tokens.encoder()
    out = packing.pack(docs, 128, keep_ids=True).collect()
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    ids = Counter()
    for r in rows:
        ids[(r[0], np.append(np.frombuffer(code.encode(r[1]), code.dtype), 0).astype("<u4").tobytes())] += 1
    for doc_id, data in ids:
        own = [r for r in out if r.doc_id == doc_id and r.doc_tokens == len(data) // 4 and data[4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids)]
        assert sum(r.length for r in own) >= len(data) // 4
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)
    assert sum(r.length for r in out) == sum(len(d) // 4 * n for (_, d), n in ids.items())


def test_nothing_to_pack(none):
    assert packing.pack(none).collect() == []


# tokens and token files


ODD = ["", " ", "  a", "a  b", " a\n b\t c ", "it's 've  ' s", "日本 語 a", "a b  c", "x\x1c y", "🙂 🙂🙂", "12a b12 ½", "A.b, c!! d...", "é ñandú\r\n\r\n ü", "one.\nTwo three,\nFour\n\nFive\n", "a\n", "ab \ncd", "x\n y", "ab\n\tcd e\u00a0f"]
MARKS = ["<|endoftext|>", "<|endoftext|> x", "hello <|endoftext|> x", "x <|endoftext|>", "a<|endoftext|><|endoftext|>b c", "<|endoftext|", "a b <|endoftext|>\nc  d"]


@pytest.mark.parametrize("text", ODD + MARKS)
def test_chunks_give_the_library_ids(text):
    """Against a tokenizer of its own, loaded and called as the library's users do."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code = tokens.encoder()
    for _ in range(2):  # new, then remembered
        assert np.frombuffer(code.encode(text), code.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoded_documents_end():
    code = tokens.encoder()
    ids, ends = code.encoded(["a b", None, ""], 7)
    assert ids.tolist() == [*np.frombuffer(code.encode("a b"), code.dtype).tolist(), 7, 7, 7] and ends.tolist() == [len(ids) - 2, len(ids) - 1, len(ids)]
    assert [len(x) for x in code.encoded([], 7)] == [0, 0]


def test_elias_fano_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (1, 10, 10**6, 10**12):
            values = np.sort(r.integers(0, top, n))
            coded = token_files.EliasFano(token_files.EliasFano.encode(values))
            assert (coded.select(0, n) == values).all()
            for _ in range(10):
                a, b = sorted(r.integers(0, n + 1, 2).tolist())
                assert (coded.select(a, b) == values[a:b]).all()


def test_token_files(spark, docs, rows, tmp_path, monkeypatch):
    code = tokens.encoder()
    files = token_files.write_tokens(docs, f"file://{tmp_path}/t")
    found = token_files.read_tokens(files).collect()
    expected, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(np.frombuffer(code.encode(r[1]), code.dtype), 2).astype("<u4")
        expected.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def test_no_token_files(none, tmp_path):
    assert token_files.read_tokens(token_files.write_tokens(none, f"file://{tmp_path}/n")).collect() == []


# near-duplicate groups


def brute_groups(rows, words=5, near=80):
    sets = []
    for r in rows:
        w = split(r[1])
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= near * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(g)) for r, s, g in zip(rows, sets, group, strict=True)), key=str)


ALIKE = pytest.mark.parametrize(("n", "near"), [(3, 90), (5, 80)])


@ALIKE
def test_groups(docs, rows, n, near):
    assert got(jaccard.near_groups(docs, n, near)) == brute_groups(rows, n, near)


@ALIKE
def test_groups_of_chains_and_hubs(spark, n, near):
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows, i = [], 0
    for _ in range(25):  # each copy differs from the base by a little, so copies differ from each other by more
        words = list(base)
        words[r.randrange(80)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(words)))
        i += 1
    words = list(base)
    for k in range(30):  # a chain in which only neighbours are alike
        words[(k * 7) % 80] = f"c{k}"
        rows.append((i, " ".join(words)))
        i += 1
    assert got(jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, near)) == brute_groups(rows, n, near)


@ALIKE
def test_groups_of_random_edits(spark, n, near):
    """Pages of one template, groups of near copies that share passages, and texts of few common words, about both sides of the similarity."""
    r, rows = random.Random(n), []
    template, passage = [f"t{k}" for k in range(150)], [f"p{k}" for k in range(60)]
    for i in range(60):
        words = list(template)
        for _ in range(r.choice([1, 2, 3, 6, 12])):
            words[r.randrange(150)] = f"own{i}_{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    for g in range(8):
        body = [f"g{g}_{k}" for k in range(r.randint(20, 90))] + passage
        for i in range(6):
            words = [w for w in body if r.random() > 0.015]
            rows.append((1000 + 10 * g + i, " ".join(words)))
    rows += [(2000 + i, " ".join(r.choice("abc") for _ in range(r.randint(1, 40)))) for i in range(60)]
    assert got(jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, near)) == brute_groups(rows, n, near)


def test_links_across_components_are_found(spark):
    """Linked sets of different components meet among the pairs that are searched last, and none of one component do."""
    r, rows = random.Random(4), []
    base = [f"w{k}" for k in range(200)]
    for i in range(40):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(200)] = f"x{i}_{r.randrange(5)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    nodes, lists = jaccard._index(docs, 5, 80)
    keys = {k.start: k.key for k in nodes.collect()}
    labels = spark.createDataFrame([(k, i % 3) for i, k in keys.items()], "key long, root long")
    pairs = {tuple(p) for p in got(jaccard._apart(jaccard._open(lists, labels), nodes, 80))}
    root = {k: i % 3 for i, k in keys.items()}
    linked = {tuple(sorted((keys[a], keys[b]))) for a in keys for b in keys if a < b and len({x[2] for x in brute_groups([rows[a], rows[b]], 5, 80)}) == 1}
    assert {p for p in linked if root[p[0]] != root[p[1]]} <= pairs and len(linked) > 10
    assert all(root[a] != root[b] for a, b in pairs)


def test_pages_of_a_template_never_meet(spark):
    r, rows = random.Random(9), []
    for i in range(300):
        words = [f"t{k}" for k in range(300)]
        for k in r.sample(range(300), 12):
            words[k] = f"own{i}_{k}"
        rows.append((i, " ".join(words)))
    _, lists = jaccard._index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90)
    assert jaccard._led(lists).count() == 0


def test_groups_query(spark, tmp_path):
    """The query on a table of its own: copies on both sides of its similarity, and rows without words."""
    r = random.Random(8)
    rows = [(100, None), (101, " \t"), (102, "A b"), (103, "a B")]
    for i in range(40):
        words = [f"v{i % 5}_{k}" for k in range(120)]
        for _ in range(r.randint(0, 5)):
            words[r.randrange(120)] = f"y{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(jaccard.op2_jaccard(spark, str(tmp_path))) == brute_groups(rows, 3, 90)


def test_no_groups(none):
    assert jaccard.near_groups(none).collect() == []


def test_divide_skip_counts():
    r = random.Random(6)
    for _ in range(30):
        lists = [np.array(sorted(r.sample(range(40), r.randint(1, 40)))) for _ in range(12)]
        count = Counter(x for one in lists for x in one.tolist())
        for least in (1, 3, 9, 12):
            assert jaccard.t_occurrence(lists, least) == {k: n for k, n in count.items() if n >= least}


def test_one_of_each(docs, rows):
    left = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert left == {r[0] for r, g in zip(sorted(rows, key=lambda r: str((r[0], 0))), [None] * len(rows), strict=True) if r[0] is not None and (r[0],) in {(a,) for a, _, c in brute_groups(rows) if a == c}}


def test_one_row_of_null_and_repeated_ids(spark):
    rows = [(None, prose(1)), (None, prose(1)), (None, prose(2)), (5, prose(3)), (5, prose(4)), (6, prose(4) + " end"), (None, None), (None, ""), (7, prose(2).upper()), (7, prose(2) + " "), (8, "\n")]
    left = got(jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    twins = [r for r in left if r[0] == 7]
    assert len(twins) == 1 and tuple(twins[0]) in rows
    assert [r for r in left if r[0] != 7] == sorted([(None, prose(1)), (5, prose(3)), (5, prose(4)), (None, None), (None, ""), (8, "\n")], key=str)


# licences


def test_notices(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    rows = [(1, prose(1) + "\nReleased under the MIT License.\n" + prose(2)), (2, mit.upper()), (3, prose(3)), (4, None), (5, ""), (6, "Licensed, under the Apache license -- version 2.0"), (7, mit.replace("free of charge, ", "")), (None, "licensed under CC BY-NC 4.0"), (8, "under the license"), (9, "Released under the MIT License. Released under the MIT License.")]
    found = licenses.found_notices(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license")).collect()
    by = Counter((r.doc_id, r.license) for r in found)
    assert by == {(1, "MIT"): 1, (2, "MIT"): 1, (6, "Apache-2.0"): 1, (7, "MIT"): 1, (None, "CC-BY-NC-4.0"): 1, (9, "MIT"): 2}
    first = next(r for r in found if r.doc_id == 1)
    assert rows[0][1].encode()[first.start : first.stop] == b"Released under the MIT License"
    assert first.coverage == 1 and first.matched == 5


def test_notices_are_those_of_aligning_every_shift(spark):
    """Without index, chains or bounds: each template at each shift of each text, the best of what overlaps."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    templates = {f"L{k}": [" ".join(r.choice(words) for _ in range(n))] for k, n in enumerate((5, 9, 14, 30, 60, 120))}
    rows = []
    for i in range(25):
        text = []
        for _ in range(r.randint(0, 3)):
            body = r.choice(sorted(templates.values()))[0].split()
            for _ in range(len(body) // r.choice([4, 8, 1000])):
                at = r.randrange(len(body))
                body[at : at + 1] = r.choice([[], ["other"], [body[at], "more"]])
            text += [r.choice(words) for _ in range(r.randint(0, 40))] + body
        rows.append((i, " ".join(text)))
    rows += [(100, " ".join(templates["L3"] * 3)), (101, " ".join(templates["L5"] + ["gap"] * 3 + templates["L5"])), (102, templates["L5"][0] + " " + prose(8, 4000) + " " + templates["L2"][0])]
    found = {}
    for x in licenses.found_notices(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect():
        found.setdefault(x.doc_id, set()).add((x.license, x.matched, x.start, x.stop))
    for doc_id, text in rows:
        own, _, begin, stop = hashing.hashed_words([text], licenses._GAP)
        matches, taken, expected = set(), [], set()
        for name, (template,) in templates.items():
            body, _, _, _ = hashing.hashed_words([template], licenses._GAP)
            near = range(-len(body), len(own)) if doc_id < 102 else {*range(-9, 9), *range(len(own) - len(body) - 9, len(own) - len(body) + 9)}
            for shift in near if len(own) else ():
                count, i, j = licenses.aligned(body, own, shift)
                if count >= licenses.needed(len(body), 0.8):
                    matches.add((-count, len(body), i, name, j))
        for count, _, i, name, j in sorted(matches):
            if all(j < a or i > b for a, b in taken):
                taken.append((i, j))
                expected.add((name, -count, int(begin[i]), int(stop[j])))
        assert found.get(doc_id, set()) == expected, doc_id
    assert sum(map(len, found.values())) > 20


def test_common_words_by_bits():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 90))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert licenses.common(licenses.places(np.array(a)), len(a), b) == table[-1, -1]


def test_whole_long_licences_nulls_and_repeats(spark):
    gpl = max(licenses.TEMPLATES["GPL-3.0"], key=len)
    half = " ".join(gpl.split()[:2600])
    rows = [(1, gpl), (1, gpl), (2, gpl + " " + gpl), (3, half), (None, gpl), (4, None), (5, prose(1, 20_000) + " " + gpl)]
    found = Counter((r.doc_id, r.license, r.coverage) for r in licenses.found_notices(spark.createDataFrame(rows, "doc_id long, text string")).where("matched > 1000").collect())
    assert found == {(1, "GPL-3.0", 1.0): 2, (2, "GPL-3.0", 1.0): 2, (None, "GPL-3.0", 1.0): 1, (5, "GPL-3.0", 1.0): 1}


def test_no_notices(none):
    assert licenses.found_notices(none).collect() == []


# nearest neighbours


def test_nearest_is_exact(spark):
    r = np.random.default_rng(8)
    rows = [(int(i), r.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11), (2003, [None] + [1.0] * 11), (2004, [1.0, 2.0]), (None, [1.0] * 12), (20, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, vector array<float>").selectExpr("*", "1 AS score").repartition(5)
    found = vectors.nearest(df, df.where("id % 20 = 0"), k=7, block=64).collect()
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)]
    expected = {}
    for q, v in good:
        if q % 20 == 0 and q != 20:
            best = sorted((-float((v * w).sum()), i) for i, w in good if i != q)[:7]
            expected[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for q, best in expected.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [x[:2] for x in own] == [x[:2] for x in best]
        assert np.allclose([x[2] for x in own], [x[2] for x in best], rtol=0, atol=1e-12)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_shuffles_no_blocks(spark, kind):
    """Shares of several sizes, many equal vectors and lengths far apart: exact, and less is shuffled than twice the vectors' bytes."""
    r = np.random.default_rng(9)
    made = r.normal(size=(4000, 32)) * 10.0 ** r.uniform(-4, 4, (4000, 1))
    if kind == "double":
        made[::3] *= 10.0 ** r.uniform(-90, 60, (len(made[::3]), 1))
    made[1::5] = made[1]
    made[2::40] = made[1]
    made = made.astype(np.float32 if kind == "float" else np.float64)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(made.tolist())], f"id long, vector array<{kind}>").repartition(8)
    status, threshold = spark.sparkContext._jsc.sc().statusStore(), "spark.sql.autoBroadcastJoinThreshold"

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return status.executorList(False).apply(0).totalShuffleWrite()

    df = df.localCheckpoint()
    before, usual = written(), spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        found = vectors.nearest(df, df.where("id % 20 = 0"), block=64).collect()
    finally:
        spark.conf.set(threshold, usual)
    exact = made.astype(float)
    expected = []
    for q in range(0, 4000, 20):
        scores = (exact[q] * exact).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:20]
        expected += [(q, n + 1, int(i), float(scores[i])) for n, i in enumerate(best)]
    assert sorted(tuple(x) for x in found) == expected
    assert written() - before < 2 * exact.nbytes


def test_few_and_no_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "id long, vector array<double>")
    assert got(vectors.nearest(df, df.where("id = 0"))) == [(0, 1, 1, 0.5)]
    assert vectors.nearest(df.limit(0), df.limit(0)).collect() == []


# language model


def test_scores(docs, rows):
    found = scoring.score(docs).collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32((str(r[0]) if r[0] is not None else "").encode()) % 7 != 2:
            counts.update([*split(r[1]), b""])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for r in rows:
        w = [*split(r[1]), b""]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        expected.append((str(r[0]), len(w), sum(x in counts for x in w), round(base, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == sorted(expected)
    assert {r.train_tokens for r in found} == {n}
    assert all(r.score < 0 for r in found)


def test_model_is_normalised_and_learns():
    """Over all words: those with vectors, those of the groups, and one unknown word for each group."""
    counts = [(f"w{i}".encode(), 1000 - i) for i in range(400)] + [(b"", 60)] + [(f"rare{i}.".encode(), 1 + i % 40) for i in range(200)]
    groups = np.zeros((scoring.GROUPS, 2), np.int64)
    for w, n in counts:
        groups[scoring.groups_of(w, [len(w)])[0]] += (n, 1)
    v = scoring.Vocabulary(counts, groups, int(groups[:, 0].sum()), len(counts))
    assert v.own == 401 and v.wide.any()
    chain = np.concatenate([np.tile(np.arange(1, 30), 300), np.tile(np.arange(300, 330), 300), np.full(90, v.own + 3)])  # each word is followed by one word
    model, starts = scoring.Model.start(v), np.array([0, 3, 4, 2000])
    untrained = model.log10(chain, starts).mean()
    trainer, age = scoring.Trainer(model, 3), scoring.ages(len(chain), starts)
    for _ in range(3):
        for i in range(0, len(chain), 256):
            trainer.learn(chain, age, i, min(len(chain), i + 256))
    assert model.log10(chain, starts).mean() > untrained + 0.3
    symbol, log, _ = v.numbers(b"".join(w for w, _ in counts), np.array([len(w) for w, _ in counts]))
    inside = np.where(symbol < v.own, 0, log - v.group_log[np.maximum(symbol - v.own, 0)])
    before = chain[50:54]
    every = np.concatenate([np.concatenate([before, [s]]) for s in range(v.own + scoring.GROUPS)])
    of_symbol = model.log10(every, np.arange(0, len(every), 5))[4::5]
    assert abs((10**of_symbol).sum() - 1) < 1e-4
    unknown = (10 ** (of_symbol[v.own :] - v.group_log)).sum()
    assert abs((10 ** (of_symbol[symbol] + inside)).sum() + unknown - 1) < 1e-4


def test_scores_beat_word_counts(spark):
    """Held-out texts of two made-up languages: the words before a word tell which it is in."""
    r = random.Random(12)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{min(r.randint(0, 60), r.randint(0, 60))}" for _ in range(120))) for i in range(1500)]
    out = scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (out[0] - out[1]) / out[2] > 0.1


@pytest.mark.parametrize("size", [1, 40])
def test_scores_are_sums_over_tokens(spark, rows, size, monkeypatch):
    """However texts are dealt to chunks, each gets one row with its own tokens."""
    monkeypatch.setattr(scoring, "CHUNK_BYTES", size)
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    assert sorted((str(r.doc_id), r.n_tokens) for r in scoring.score(df).collect()) == sorted((str(r[0]), len(split(r[1])) + 1) for r in rows)


def test_no_scores(none):
    assert scoring.score(none).collect() == []


# quality rules


def brute_counts(text):
    text = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, rows):
    extra = [(60, "a b c d e\na b c d e\n\na b c d e f", None, None, None), (61, "a a a a a a a a", None, None, None), (62, "#*$ %% || <x> & é日本\r\n \r\n", None, None, None), (63, prose(1, 30) + "\n" + prose(1, 30), None, None, None)]
    every = rows + extra
    out = rules.judged(spark.createDataFrame(every, DOCS).selectExpr("*", "1 AS w", "2 AS votes"))
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    expected = []
    for r in every:
        c = brute_counts(r[1])
        expected.append((str(r[0]), *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert found == sorted(expected)
    assert not out.where("base_failed AND kept").collect()


def test_rules_tell_junk(spark):
    good = [(i, prose(i, 80)) for i in range(80)]
    bad = [(100 + i, " ".join(w + "%%%" for w in prose(i, 60).split())) for i in range(6)] + [(200 + i, "!! ".join(prose(i, 60).upper().split())) for i in range(6)]
    out = rules.judged(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()
    assert all(r.kept == (r.doc_id < 100) for r in out)


def test_posterior_is_that_of_plain_expectation_maximisation(spark, rows):
    """Over documents with votes of -1 (none), 0 and 1 instead of patterns, with probabilities instead of log odds."""
    junk = [(100 + i, " ".join(random.Random(i).choice(["###", "$$", "1234", "BUY NOW!!!", "word"]) for _ in range(20 + i)), "en", "s0", 1) for i in range(15)]
    got = rules.judged(spark.createDataFrame(rows + junk, DOCS), keep=0.6).collect()
    votes = np.array([[at % 3 - 1 for at in r.votes[:-1]] for r in got])
    start = np.array(rules.START)  # by vote, then class
    prior, bad, good = 0.8, np.tile(start[:, 0], (votes.shape[1], 1)), np.tile(start[:, 1], (votes.shape[1], 1))

    def posterior():
        of = np.array([1 - prior, prior]) * np.ones((len(votes), 2))
        for rule in range(votes.shape[1]):
            for vote in (0, 1):
                of[votes[:, rule] == vote] *= [bad[rule, vote], good[rule, vote]]
        return of[:, 1] / of.sum(axis=1)

    def odds():
        return np.append(np.log(good / bad).ravel(), np.log(prior / (1 - prior)))

    for _ in range(25):
        q, before = posterior(), odds()
        for rule in range(votes.shape[1]):
            for vote in (0, 1):
                own = votes[:, rule] == vote
                b = ((1 - q[own]).sum() + 20 * rules.START[vote][0]) / ((1 - q).sum() + 20)
                g = (q[own].sum() + 20 * rules.START[vote][1]) / (q.sum() + 20)
                bad[rule, vote], good[rule, vote] = (b, min(g, b / 2)) if vote == 0 else (min(b, g), g)
        prior = min(0.99, max(0.01, (q.sum() + 8) / (len(q) + 10)))
        if np.abs(odds() - before).max() < 1e-3:
            break
    q = posterior()
    assert np.abs(q - [r.posterior for r in got]).max() < 1e-9 and 0.1 < q.mean() < 0.9
    assert [r.kept for r in got] == [not r.base_failed and bool(x >= 0.6) for r, x in zip(got, q, strict=True)]


def test_rules_judge_rows_of_null_and_repeated_ids(spark):
    good = [(None if i < 40 else i, prose(i, 80)) for i in range(80)]
    bad = [(40 + i if i < 3 else None, " ".join(w + "%%%" for w in prose(i, 60).split())) for i in range(6)] + [(50, "!! ".join(prose(i, 60).upper().split())) for i in range(6)]
    docs = spark.createDataFrame(good + good[:2] + bad, "doc_id long, text string").selectExpr("*", "1 AS text_hash", "2 AS kept")
    kept = rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert got(kept.select("doc_id", "text")) == sorted(good + good[:2], key=str)


def test_rules_on_nothing(none):
    assert rules.judged(none).collect() == []
    assert rules.kept_documents(none).collect() == []


# repeated passages


def brute_cut(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out, i = set(), [], 0
    while i < len(order):
        same = [j for j in order[i:] if rows[j][0] == rows[order[i]][0]]
        fresh = set()
        for j in same:
            data = (rows[j][1] or "").encode()
            gone = bytearray(len(data))
            for k in range(len(data) - 49):
                if data[k : k + 50] in seen:
                    gone[k : k + 50] = b"\1" * 50
                fresh.add(data[k : k + 50])
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
            out.append((rows[j][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        seen |= fresh
        i += len(same)
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [2, 4096])
def test_repeats(spark, docs, rows, monkeypatch, batch):
    monkeypatch.setattr(repeats, "BATCH_DOCS", batch)
    assert got(repeats.without_repeats(docs, texts=False)) == brute_cut(rows)


def test_repeats_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_DOCS", 3)
    r = random.Random(9)
    block = prose(1, 60)
    rows = [(i, block[r.randrange(60) : r.randrange(120, 300)] + prose(i, 3) + block[r.randrange(100) : r.randrange(100, 200)]) for i in range(40)]
    rows += [(50, "a" * 300), (51, "a" * 120), (52, "ab" * 100), (53, "ba" * 60), (54, "b" + "a" * 49), (55, "é" * 60), (56, "x" + "é" * 40)]
    assert got(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), texts=False)) == brute_cut(rows)


def test_merged_intervals():
    r = np.random.default_rng(4)
    for sizes in ([80], [70, 90], [60, 75, 200, 64]):
        shards = [r.integers(0, 2, n).astype(np.uint8) for n in sizes]
        shards[-1][:50] = shards[0][:50]
        found = repeats.common_intervals(shards, 20)
        groups = {}
        for s, numbers in zip(shards, found, strict=True):
            doubled = np.concatenate([s, s]).tobytes()
            for i, n in enumerate(numbers.tolist()):
                groups.setdefault(n, set()).add(doubled[i : i + 20])
        assert all(len(g) == 1 for g in groups.values())
        assert len({x for g in groups.values() for x in g}) == len(groups)


def test_texts_and_documents_without_repeats(docs, none):
    out = repeats.without_repeats(docs).collect()
    assert all(r.n_removed == sum(s.stop - s.start for s in r.spans) for r in out)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out if "é" not in r.kept)
    kept = repeats.deduplicated_documents(docs)
    assert kept.columns == docs.columns
    assert all(r.text.strip() and r.n_chars == len(r.text) for r in kept.collect())
    assert repeats.without_repeats(none).collect() == []


def test_cut_rows_of_null_and_repeated_ids(spark):
    rows = [(1, prose(1)), (None, prose(1) + "\n" + prose(2)), (None, prose(1) + "\n" + prose(2)), (3, prose(3)), (3, prose(3) + "\n" + prose(4)), (4, prose(4)), (None, None), (5, " ")]
    left = got(repeats.deduplicated_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert left == sorted([(1, prose(1)), (None, "\n" + prose(2)), (None, "\n" + prose(2)), (3, prose(3)), (3, prose(3) + "\n" + prose(4))], key=str)


# mixing


def test_budgets_share_by_weight():
    assert mixing.budgets([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.budgets([10, 1000], [3, 1], 1.5, 2) == pytest.approx([20, 1495])
    assert mixing.budgets([0, 0], [3, 1], 1.5, 2) == [0, 0]


def test_mix(docs, rows):
    a, b = got(mixing.plan_mix(docs).select("doc_id", "size", "target", "taken", "source_rank")), got(mixing.plan_mix(docs.repartition(7)).select("doc_id", "size", "target", "taken", "source_rank"))
    assert a == b
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(len((r[1] or "").encode().split()) for r in rows if r[3] == s) for s in names]
    targets = mixing.budgets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for i, target in enumerate(targets):
        assert sum(r[3] for r in a if r[4] == i) == int(target)
    assert all(0 <= r[3] <= 2 * r[1] for r in a)


def test_null_ids_mix_by_text(spark):
    out = mixing.plan_mix(spark.createDataFrame([(None, prose(i), "s") for i in range(40)] + [(None, None, "s"), (3, "a b", "s")], "doc_id long, text string, source string")).collect()
    assert len({r["key"] for r in out}) == 42
    assert sum(r["taken"] for r in out) == int(out[0]["target"])


def test_mixed_documents(docs):
    docs = docs.selectExpr("*", "7 AS taken", "8 AS source_rank", "9 AS target")
    plan = mixing.plan_mix(docs)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = out.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == plan.agg(F.sum("taken")).first()[0]


def test_no_mix(none):
    assert mixing.plan_mix(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []


# co-trained classifier


def test_whole_licenses_and_changed_words(spark):
    whole = {name: max(texts, key=len) for name, texts in licenses.TEMPLATES.items()}
    rows = [(i, f"{prose(i)}\n{text}\n{prose(i + 500)}") for i, text in enumerate(whole.values())]
    rows += [(100, prose(7) + " Released under the old License. " + prose(8)), (101, "released beneath the MIT license"), (102, prose(9) + " Released under the new MIT License " + prose(10))]
    found = {r.doc_id: r for r in licenses.found_notices(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("matched").collect()}
    for i, (name, text) in enumerate(whole.items()):
        assert (found[i].license, found[i].coverage) == (name, 1.0) and len(rows[i][1].encode()[found[i].start : found[i].stop]) >= len(text.encode()) - 2
    assert (found[101].license, found[101].matched) == ("MIT", 4) and found[102].coverage == 1.0 and found[100].coverage >= 0.8
    assert {"MPL-2.0", "LGPL-3.0", "AGPL-3.0", "ISC", "BSD-2-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense"} <= set(whole)


def test_cotraining_on_held_out(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "***" for w in prose(i, 40).split()) if bad else prose(i, 40), "en", "junk" if bad and i % 8 else "site"))
        if i < 240:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, None, None), (901, "", "en", "site"), (None, prose(2), "en", "site"), (3, prose(3, 40), "en", "site")]
    labels += [(None, 1, 0), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS quality", "2 AS toxic")
    out = cotraining.classified(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and 240 <= r.doc_id < 400]
    right = sum((r.quality >= 0.5) == (r.doc_id % 4 != 0) for r in held)
    assert right >= 0.97 * len(held)


def test_exchange_sees_every_document(spark, docs, rows):
    """Slopes and bends over all rows but the labelled ones, beside a loop over documents; a goal without labels says nothing."""
    r = np.random.default_rng(4)
    learned = {"quality": ([r.normal(size=w) for w in cotraining.WIDTHS], [(2.0, 0.1), (5.0, -0.2)], 0.7, True), "toxic": ([np.zeros(w) for w in cotraining.WIDTHS], [(0.0, 0.0)] * 2, 0.5, False)}
    found = cotraining.exchanged(docs, learned, np.array([3, 50]))
    chance = lambda x: 1 / (1 + math.exp(-np.clip(x, -30, 30)))
    for view in (0, 1):
        expected, n = np.zeros((2, 2, cotraining.WIDTHS[view] + 1)), 0
        for row in rows:
            both = cotraining.features(pd.DataFrame([row[1:4]], columns=["text", "lang", "source"]))
            own, other = ((side[2] * w[side[1]]).sum() for side, w in zip((both[view], both[1 - view]), (learned["quality"][0][view], learned["quality"][0][1 - view]), strict=True))
            a, b = learned["quality"][1][1 - view]
            told, p = chance(a * other + b - math.log(0.7 / 0.3)), chance(own)
            if row[0] not in (3, 50) and max(told, 1 - told) >= cotraining.SURE:
                for column, value in zip(both[view][1], both[view][2], strict=True):
                    expected[int(told > 0.5), 0, column] += value * (p - int(told > 0.5))
                    expected[int(told > 0.5), 1, column] += value**2 * max(p * (1 - p), 0.02)
                expected[int(told > 0.5), :, -1] += 1
                n += 1
        assert n and np.allclose(found["quality", view], expected)
    assert not found["toxic", 0].any() and cotraining.pull(found["toxic", 0]) is None


def test_pull_is_the_slope_of_the_rows_it_stands_for():
    """One document of each class as pseudo-labelled rows: the pull is the numeric derivative of their loss."""
    frame = pd.DataFrame({"doc_id": [1, 2], "text": ["stone river walks", "junk *** junk"], "source": ["a", "b"], "lang": ["en", "en"]})
    both, r = cotraining.features(frame), np.random.default_rng(1)
    weights = [r.normal(size=w) / 10 for w in cotraining.WIDTHS]
    weights[1][both[1][1]] = np.where(both[1][0] == 0, 3.0, -3.0)
    weights[1][np.intersect1d(both[1][1][both[1][0] == 0], both[1][1][both[1][0] == 1])] = 0
    sums = cotraining.sure_sums(frame, {"g": (weights, [(1.0, 0.0)] * 2, 0.5, True)}, np.array([], np.int64))["g", 0]
    slope, _ = cotraining.pull(sums)
    rows, columns, values = both[0]

    def loss(w):
        x = np.bincount(rows, values * w[columns], 2)
        return cotraining.TRUST * 0.5 * (np.logaddexp(0, -x[0]) + np.logaddexp(0, x[1]))

    for column in set(columns.tolist()):
        step = np.zeros(cotraining.CONTENT)
        step[column] = 1e-5
        assert abs((loss(weights[0] + step) - loss(weights[0] - step)) / 2e-5 - slope[column]) < 1e-8


@pytest.fixture(scope="module")
def few_labels(spark):
    """Sources tell the class; each class has 300 words of its own, of which 48 labelled documents show some. Later ones have no source."""
    r, rows = random.Random(8), []
    for i in range(1000):
        kind = i % 2
        words = [f"w{kind}x{r.randrange(300)}" for _ in range(6)] + [f"c{r.randrange(200)}" for _ in range(24)]
        r.shuffle(words)
        rows.append((i, " ".join(words), "en", None if i >= 800 else "site" if kind ^ (r.random() < 0.03) else "junk"))
    labels = [(i, i % 2, 0) for i in range(48)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_exchange_helps_where_labels_are_few(few_labels):
    rows, docs, labels = few_labels
    right = []
    for rounds in (0, 2):
        weights, lines, _, able = cotraining.learn(docs, labels, rounds)["quality"]
        side = cotraining.features(pd.DataFrame(rows[800:], columns=["doc_id", "text", "lang", "source"]))[0]
        odds = lines[0][0] * np.bincount(side[0], side[2] * weights[0][side[1]], 200) + lines[0][1]
        right.append(np.mean((odds > 0) == (np.arange(800, 1000) % 2 == 1)))
        assert able
    assert right[1] >= right[0] + 0.05, right


def test_scores_beside_a_loop(few_labels):
    """Each document's score from the learned weights, one feature at a time."""
    rows, docs, labels = few_labels
    learned = cotraining.learn(docs, labels)
    found = {r.doc_id: r for r in cotraining.classified(docs, labels).collect()}
    assert len(found) == len(rows)
    for row in rows[::25]:
        both = cotraining.features(pd.DataFrame([row], columns=["doc_id", "text", "lang", "source"]))
        for goal, (weights, lines, share, _) in learned.items():
            odds = -math.log(share / (1 - share))
            for (_, columns, values), w, (a, b) in zip(both, weights, lines, strict=True):
                odds += a * sum(v * w[c] for c, v in zip(columns, values, strict=True)) + b
            assert abs(1 / (1 + math.exp(-odds)) - getattr(found[row[0]], goal)) < 1e-6
        assert found[row[0]].kept == (found[row[0]].quality >= 0.5 and found[row[0]].toxic < 0.5)


def test_classifier_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotraining.classified(docs, empty).count() == docs.count()
    assert cotraining.classified(none, empty).collect() == []
