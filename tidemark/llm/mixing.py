"""Mix sources to target weights with exact word budgets.

Documents get hash-random keys. Within a source they are ordered by key: a key's leading digits
name its range, word counts of the ranges are summed up along the source, and a running sum within
each range adds to them. The source's budget cuts that order: whole epochs first, then the documents
before the cut once more, the document on the cut with the words that are left.

No source lies in one task: the ranges of a source are dealt out like those of any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table, word_count

#: Rows that a range holds on average, at most.
RANGE_ROWS = 50_000


def budgets(sizes: Sequence[int], weights: Sequence[float], share: float, epochs: float) -> list[float]:
    """Targets by weight that sum to share * sum(sizes); none above epochs * its size, the excess going to the others by weight.

    Sources reach their limit in the order of limit / weight, so the common rate follows from one walk in that order.
    """
    left, weight = share * sum(sizes), float(sum(weights))
    targets = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (epochs * sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        rate = left / weight
        if epochs * sizes[i] > rate * weights[i]:
            for j in order[at:]:
                targets[j] = rate * weights[j]
            break
        targets[i] = float(epochs * sizes[i])
        left -= targets[i]
        weight -= weights[i]
    return targets


def _keyed(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size, key and tie of each row of docs, and more."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"), *more)


def _taken(base: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """base (_keyed) with source_rank, source_size, target and taken, but without source. Rows are dealt out once, by source and range."""
    found = sorted(base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    if not found:
        none = F.lit(None)
        return base.drop("source").withColumns({"source_rank": none.cast("int"), "source_size": none.cast("long"), "target": none.cast("double"), "taken": none.cast("long")})
    weight = [float(weights[i % len(weights)]) for i in range(len(found))]
    targets = budgets([r["size"] for r in found], weight, share, epochs)
    digits = max(2, math.ceil(math.log(max(1, max(r["n"] for r in found) / RANGE_ROWS), 16)))
    sources = base.sparkSession.createDataFrame([(i, r["source"], r["size"], t) for i, (r, t) in enumerate(zip(found, targets, strict=True))], "source_rank int, source string, source_size long, target double")
    placed = base.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("source", "of").withColumn("range", F.substring("key", 1, digits))
    before = placed.groupBy("source_rank", "range").agg(F.sum("size").alias("words"))
    before = before.select("source_rank", "range", (F.sum("words").over(W.partitionBy("source_rank").orderBy("range")) - F.col("words")).alias("before"))
    placed = placed.join(before, ["source_rank", "range"])
    end = F.col("before") + F.sum("size").over(W.partitionBy("source_rank", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - whole * F.col("source_size")
    once = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return placed.withColumn("end", end).withColumn("taken", (whole * F.col("size") + once).cast("long")).drop("end", "before", "range")


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, source_rank and key for each row of docs (doc_id, text, source).

    weights repeat over the sources in code-point order, the null source last. taken counts words, repeats included;
    the sum over a source is its target rounded down. Null text: size 0, taken 0. Rows with the same doc_id are
    documents of their own; equal keys are ordered by doc_id, size and a hash of the text. A null doc_id has the key of its text, so that
    many of them spread over the ranges. No rows: no rows. Other columns are left out. Reruns agree, as keys depend on rows and seed only.
    The driver sees one row per source.
    """
    base = stored(_keyed(docs, seed), "mix")
    return _taken(base, weights, share, epochs).select("doc_id", "size", "source_size", "target", "taken", "source_rank", "key")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: a row per epoch of a document, and its first words where the budget cuts it.

    Each row carries its own document through the plan of plan_mix, so rows that share a doc_id, or have none, are told apart whatever
    their source and size. Documents of which no word is taken are left out; n_chars, where docs has it, follows the text.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    plan = _taken(_keyed(docs, seed, whole), weights, share, epochs).where("taken > 0").select("row", "size", "taken")
    copies = F.transform(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int")), lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")))
    rows = plan.withColumn("words", F.explode(copies))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(cut))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('17' || coalesce(':' || coalesce(CAST(doc_id AS VARCHAR), md5(text)), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size AS top, 2.0::DOUBLE * source_size / weight AS ratio, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM w),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM o),
f AS (SELECT arg_min(rate, nth_ratio) FILTER (WHERE top > rate * weight) AS rate FROM (SELECT *, row_number() OVER (ORDER BY ratio, nth) AS nth_ratio FROM r)),
t AS (SELECT r.source, source_size, CASE WHEN top > f.rate * weight THEN f.rate * weight ELSE top END AS target FROM r, f),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS whole,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - (stop - size))) AS BIGINT) AS taken FROM p
"""
