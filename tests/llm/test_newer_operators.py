"""Languages, conversations and resampling: against brute force, and with nulls, empty and long texts, ties, repeats, no rows and extra columns."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, prose
from tidemark.llm import conversations, languages, resampling

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# Resampling


def brute_features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_resampled(docs, target, percent=25, least=20, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in brute_features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for doc_id, text in docs:
        words, found = brute_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if len(words) >= least:
            able.append(out[-1])
    able.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = i + 1
    return sorted(map(tuple, out), key=str)


ODD = [(40, None), (41, ""), (42, " \n\t "), (43, "One two"), (44, "one TWO"), (50, "x" * 5000 + " y " + "Z9" * 300), (51, "é日本 " * 40), (52, "a\x00b-c_d\x7fe 0@1" * 9), (7, prose(7)), (7, prose(7)), (None, prose(5)), (None, prose(6)), (60, "word " * 20_000)]


def test_resampling_like_brute_force(spark):
    rows = [(i, prose(i)) for i in range(60)] + ODD
    target = [prose(i) for i in range(200, 215)] + [None, ""]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n long, score long, bucket long").repartition(3)
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute_resampled(rows, target)
    assert sorted(r.doc_id or -1 for r in resampling.drawn_documents(docs, spark.createDataFrame([(t,) for t in target], "text string")).select("doc_id").distinct().collect()) == sorted({x[0] or -1 for x in brute_resampled(rows, target) if x[4]})


def test_resampling_of_the_tables(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute_resampled([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert sorted(map(tuple, resampling.op13_resampling(spark, SF).collect()), key=str) == expected


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, prose(1)), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, resampling.resample(some, none).collect())) == brute_resampled([(1, prose(1)), (2, None)], [])


def test_crc_of_slices(spark):
    texts = pa.array(["zz", "Ab cd", None, "", "cd", "cd ef gh"])
    for part in (texts, texts.slice(1, 3), texts.slice(4)):
        bucket, text, n = resampling.features(part, 997)
        expected = [(zlib.crc32(f.encode()) % 997, i) for i, t in enumerate(part.to_pylist()) for f in brute_features(t)[1]]
        assert sorted(zip(bucket.tolist(), text.tolist(), strict=True)) == sorted(expected)
        assert n.tolist() == [len(brute_features(t)[0]) for t in part.to_pylist()]


# Conversations


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, fate = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def brute_repair(turns):
    """Cheapest and then least audit by Dijkstra over whole lists of roles, the grammar checked by a pattern at the end."""
    seen, faults = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles[-1:] if roles != "s" else "s") in done:
            continue
        done.add((i, roles[-1:] if roles != "s" else "s"))
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            break
        begins = lambda r: bool(re.fullmatch("(s?(ua)*u?)?", r))
        if i < len(turns):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if faults[i] not in ("b", "d"):
                first = turns[i][1][:1]
                more = 5 if faults[i] == "t" else 0
                if first and begins(roles + first):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + first))
                for r in "ua":
                    if begins(roles + r) and r != first:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + r))
        for r in "ua":
            if begins(roles + r):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + r))
    lines, at, k = [], 0, 0
    for e in audit:
        if e == "I":
            lines.append({"u": "user", "a": "assistant"}[roles[k]] + ":")
        elif e != "D":
            lines.append((turns[at][1] if e == "K" else {"u": "user", "a": "assistant"}[roles[k]]) + ":" + turns[at][2])
        k += e != "D"
        at += e != "I"
    return faults, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def brute_report(rows, original):
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append(tuple(rest))
    out = []
    for conv in original:
        turns = sorted(by[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, cost, audit, digest, _ = brute_repair(turns)
        known = [t for t, _, _ in turns if t is not None]
        firsts = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def odd_turns(seed, conversations_=60):
    r, out = random.Random(seed), []
    texts = ["Fine.", "Fine.", "no end", "So?  ", "", " \n", None, "Yes!", "é. ", "x" * 50]
    for c in range(conversations_):
        for _ in range(r.choice([1, 2, 3, 6, 9, 14])):
            out.append((r.choice([c, c, c, None if c == 5 else c]), r.choice([*range(12), None]), r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(texts)))
    return out


def test_repair_like_brute_force(spark):
    rows = odd_turns(1)
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS nth", "2 AS fault", "'x' AS fate", "3 AS copy").repartition(3)
    found = conversations.repair_report(conversations.damaged(frame), "alive")
    assert sorted(map(tuple, found.collect()), key=str) == brute_report(brute_damage(rows), {r[0] for r in rows})
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    kept = conversations.repair_report(frame.withColumn("alive", F.lit(5)))
    assert sorted(map(tuple, kept.collect()), key=str) == brute_report(plain, {r[0] for r in rows})


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, conversations.op12_conversations(spark, SF).collect()), key=str) == brute_report(brute_damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_change_nothing(piece, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", piece)
    r = random.Random(piece)
    for _ in range(400):
        turns = [(i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["A.", "B.", "C", "", "D.", f"{r.random()}."])) for i in range(r.randint(0, 16))]
        faults, cost, audit, _, lines = brute_repair(turns)
        mine = []
        one = conversations.Repair(lambda e, t, role, text, mine=mine: e != "D" and mine.append(f"{role}:{text}"))
        for (turn, role, text), f in zip(turns, faults, strict=True):
            one.feed(turn, role, text, ["", "b", "d", "t"].index(f))
        one.end()
        assert (one.cost, "".join(one.settled), mine) == (cost, audit, lines)


def test_long_conversation_and_repaired_turns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(3000)] + [(2, 0, "system", "s."), (2, 1, "assistant", "a."), (3, 0, "user", " ")]
    out = {r.conv_id: r for r in conversations.repair_report(spark.createDataFrame(rows, TURNS)).collect()}
    assert out[1].cost == 0 and out[1].audit == "K" * 3000 and (out[2].cost, out[2].audit) == (1, "RK") and out[3].audit == "D"
    assert out[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    left = conversations.repaired(spark.createDataFrame([*rows[:4], (1, 9, "user", "end."), (2, 0, "user", "u.")], TURNS)).orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r["at"], r.edit, r.role) for r in left] == [(1, 0, "K", "user"), (1, 1, "K", "assistant"), (1, 2, "K", "user"), (1, 3, "K", "assistant")]
    assert conversations.repair_report(spark.createDataFrame([], TURNS)).count() == 0 and conversations.repaired(spark.createDataFrame([], TURNS)).count() == 0


# Languages


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    found = languages.op11_languages(spark, f"{SF}/../sf0.01").join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out and re.search(r"[^\W\d_]", r.text or "")]
    right = [r.lang_pred == r.lang for r in held]
    sure = [r.lang_pred == r.lang for r in held if not r.rejected]
    assert np.mean(right) >= 0.97 and np.mean(sure) >= 0.98 and len(sure) >= 0.9 * len(held)


def test_grams_like_brute_force():
    column = pa.array(["Ab, é!", None, "", "x", "it's it's"])
    for part in (column, column.slice(3)):
        bucket, text = languages.grams(part)
        n = Counter(text.tolist())
        for i, t in enumerate(part.to_pylist()):
            data = bytes(languages._WORD[b] for b in f" {(t or '').lower()} ".encode())
            runs = [data[a : a + k] for k in languages.ORDERS for a in range(len(data) - k + 1)]
            runs = [x for x in runs if 32 not in x[1:-1] and x.strip()]
            assert n[i] == len(runs)
    two = languages.grams(pa.array(["it's it's"]))[0]
    assert len(set(two.tolist())) * 2 <= len(two) and set(two.tolist()) <= set(languages.grams(pa.array(["zz it's"]))[0].tolist())


def test_odd_rows_of_languages(spark):
    rows = [(i, t, lang, None, None) for i in range(40) for t, lang in (("the house and the street " * 3, "en"), ("das haus und die strasse " * 3, "de"))]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 % 34", "en"), (103, "the", None), (None, "und die strasse", None), (104, "the house " * 50_000, None), (105, "日本", None)]
    docs = spark.createDataFrame(rows + [(*o, None, None) for o in odd], DOCS).selectExpr("*", "1 AS n", "2 AS nth", "3 AS u", "4 AS score").repartition(3)
    found = {(r.doc_id, r.lang_pred) for r in languages.identified(docs).where("doc_id IS NULL OR doc_id >= 100").collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "de"), (104, "en")} <= found and len(found) == 7
    assert languages.identified(docs).count() == len(rows) + len(odd)
    assert languages.identified(spark.createDataFrame([], DOCS)).count() == 0
    blind = languages.identified(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in blind] == [("und", 0.0)]
    one = languages.identified(docs.withColumn("lang", F.lit("xx"))).where("doc_id = 103").first()
    assert one.lang_pred == "xx" and one.score == 1.0


# Mixing stage


def test_mixed_rows_follow_the_plan_whatever_their_ids(spark):
    """Null and repeated ids of equal sizes in several sources, and columns named like those of the plan."""
    from tidemark.llm import mixing

    rows = [(None, "a b c", "x"), (None, "d e f", "y"), (None, "d e f", "y"), (3, "g h i", "x"), (3, "g h i", "y"), (3, "j k l", None), (3, "j k l", None), (4, "m n o", None), (5, None, "x"), (6, " ", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'q' AS key", "2 AS taken", "3 AS row", "4 AS __id", "5 AS `a.b`").repartition(3)
    plan = Counter()
    for r in mixing.plan_mix(docs).collect():
        plan[r.source_rank] += r.taken
    words = Counter()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        words[{"x": 0, "y": 1, None: 2}[r.source]] += len(r.text.split())
    assert words == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
