"""Full text by trigrams, ranked by BM25.

A term matches where it occurs in the lower-cased content, as a phrase of overlapping trigrams does; terms of fewer than three code
points are left out of a conjunction and alone match nothing. rank = -sum(idf f 2.2 / (f + 1.2 (0.25 + 0.75 dl / avgdl))), with dl the
number of trigrams of the row, idf = ln((N - n + 0.5) / (n + 0.5)) or 1e-6 where that is not positive, occurrences overlapping.

``scan`` reads the contents once: the counts of matching rows are written, the statistics of all rows are observed on the way.
``Postings`` is a kept table of trigram positions, sorted by trigram, of which a search reads only the row groups of its trigrams. Both
give the same rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prismara.functions.scalars import query_terms
from prismara.storage import materialise, table_path

FTS_MOST = 1_000
K1, B = 1.2, 0.75
IDF_LEAST = 1e-6


def usable_terms(text: str) -> list[str]:
    return [t for t in query_terms(text) if len(t) >= 3]


def _meets_itself(term: str) -> bool:
    """Whether two occurrences of the term can overlap."""
    return any(term.endswith(term[:n]) for n in range(1, len(term)))


def occurrences(content: Column, term: str) -> Column:
    """Places of ``term`` in lower-cased ``content``, overlapping ones included; where they cannot overlap, what its removal saves tells."""
    low = F.lower(content)
    if _meets_itself(term):
        return F.regexp_count(low, F.lit("(?=" + re.escape(term) + ")"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("int")


def _score(terms: list[str], n: int, avgdl: float, holding: dict[str, int], f: list[Column], dl: Column) -> Column:
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = math.log((n - holding[t] + 0.5) / (holding[t] + 0.5))
        idf = idf if idf > 0 else IDF_LEAST
        total = total + F.lit(idf) * f[i] * (K1 + 1) / (f[i] + K1 * ((1 - B) + B * dl / (avgdl or 1.0)))
    return -total


def length(content: Column) -> Column:
    return F.greatest(F.length(content) - 2, F.lit(0))


def search_scan(docs: DataFrame, text: str, k: int, key: str = "asset_id", content: str = "content") -> DataFrame:
    """(key, rank) of the k best rows, smallest rank first, ties by key; null contents match nothing but count as rows."""
    terms = usable_terms(text)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("rank")).limit(0)
    body = F.coalesce(F.col(content), F.lit(""))
    counted = docs.select(key, length(body).cast("double").alias("dl"), *[occurrences(body, t).cast("double").alias(f"f{i}") for i, t in enumerate(terms)])
    seen = Observation()
    counted = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"h{i}") for i in range(len(terms))])
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & (F.col(f"f{i}") > 0)
    matched = materialise(counted.where(every), "matched")
    n, dl = seen.get["n"], seen.get["dl"]
    holding = {t: seen.get[f"h{i}"] for i, t in enumerate(terms)}
    score = _score(terms, n, (dl or 0) / n if n else 0.0, holding, [F.col(f"f{i}") for i in range(len(terms))], F.col("dl"))
    return matched.select(key, score.alias("rank")).orderBy("rank", key).limit(max(1, min(FTS_MOST, k)))


def postings(docs: DataFrame, key: str = "asset_id", content: str = "content") -> DataFrame:
    """(trigram, key, pos): every overlapping window of three code points of the lower-cased content."""
    body = docs.select(key, F.lower(F.coalesce(F.col(content), F.lit(""))).alias("c")).where(F.length("c") >= 3)
    rows = body.select(key, "c", F.explode(F.sequence(F.lit(1), F.length("c") - 2)).alias("pos"))
    return rows.select(F.substring(F.col("c"), F.col("pos"), F.lit(3)).alias("trigram"), key, "pos")


def lengths(docs: DataFrame, key: str = "asset_id", content: str = "content") -> DataFrame:
    return docs.select(key, length(F.coalesce(F.col(content), F.lit(""))).cast("double").alias("dl"))


class Postings:
    """A kept index of (trigram, key, pos) and (key, dl), made once and searched any number of times."""

    def __init__(self, docs: DataFrame, key: str = "asset_id", content: str = "content", path: str | None = None, files: int | None = None):
        self.spark, self.key = docs.sparkSession, key
        self.path = path or table_path(self.spark, "postings")
        rows = postings(docs, key, content)
        spread = rows.repartitionByRange(files, "trigram", key) if files else rows.repartitionByRange("trigram", key)
        spread.sortWithinPartitions("trigram", key).write.parquet(f"{self.path}/postings")
        lengths(docs, key, content).write.parquet(f"{self.path}/lengths")

    def search(self, text: str, k: int) -> DataFrame:
        return search_postings(self.spark.read.parquet(f"{self.path}/postings"), self.spark.read.parquet(f"{self.path}/lengths"), text, k, self.key)


def search_postings(posted: DataFrame, measured: DataFrame, text: str, k: int, key: str = "asset_id") -> DataFrame:
    """As search_scan, from postings() and lengths(): a term occurs at a start where all its trigrams stand at their places."""
    terms = usable_terms(text)
    if not terms:
        return measured.select(key, F.lit(0.0).alias("rank")).limit(0)
    spark = posted.sparkSession
    wanted = [(i, t[j : j + 3], j, len(t) - 2) for i, t in enumerate(terms) for j in range(len(t) - 2)]
    asked = spark.createDataFrame(wanted, "term int, trigram string, place int, places int")
    grams = sorted({w[1] for w in wanted})
    met = posted.where(F.col("trigram").isin(grams)).join(F.broadcast(asked), "trigram")  # a row per trigram of the query
    starts = met.groupBy(key, "term", "places", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("n")).where("n = places")
    counts = materialise(starts.groupBy(key).agg(*[F.count_if(F.col("term") == i).cast("double").alias(f"f{i}") for i in range(len(terms))]), "counted")
    n, dl = measured.agg(F.count("*"), F.sum("dl")).first()
    holding = counts.agg(*[F.count_if(F.col(f"f{i}") > 0) for i in range(len(terms))]).first()
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & (F.col(f"f{i}") > 0)
    score = _score(terms, n, (dl or 0) / n if n else 0.0, dict(zip(terms, holding)), [F.col(f"f{i}") for i in range(len(terms))], F.col("dl"))
    return counts.where(every).join(measured, key).select(key, score.alias("rank")).orderBy("rank", key).limit(max(1, min(FTS_MOST, k)))
