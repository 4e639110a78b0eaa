"""The pipeline on sf0.001 beside plain Python for the stages that it can follow."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_operators import brute_cut, brute_groups
from tidemark.llm import mixing, rules, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp(name)}/t"
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_rules_keep_what_they_judge_good(stages):
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in rules.judged(before).collect() if r.kept}
    assert sorted(r[0] for r in rows(after)) == sorted(kept)


def test_one_of_each_group(stages):
    before, after = stages["jaccard_join"]
    assert sorted(r[0] for r in rows(after)) == sorted(a for a, _, c in brute_groups(rows(before)) if a == c)


def test_passages_go_once(stages):
    before, after = stages["suffix_dedup"]
    left = {r[0]: len(r[1].encode()) for r in rows(after)}
    for doc_id, n, gone, _, _ in brute_cut(rows(before)):
        assert abs(left.get(doc_id, 0) - (n - gone)) <= 6 or left.get(doc_id) is None and n - gone < 60


def test_mix_meets_its_budget(stages):
    before, after = stages["source_mixing"]
    words = Counter()
    for r in after.collect():
        words[r.source] += len(r.text.encode().split())
    sizes = Counter()
    for r in before.collect():
        sizes[r.source] += len(r.text.encode().split())
    names = sorted(sizes)
    targets = mixing.budgets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    assert [words[s] for s in names] == [int(t) for t in targets]


def test_every_token_is_packed(stages):
    before, after = stages["packing"]
    code = tokens.encoder()
    total = sum(len(np.frombuffer(code.encode(r[1]), code.dtype)) + 1 for r in rows(before))
    assert after.groupBy().sum("length").first()[0] == total
    fill = after.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 1024
    assert len(fill) <= -(-total // 1024) + 2
