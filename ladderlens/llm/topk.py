"""Exact top-k search by inner product, term at a time.

Vectors become sparse integer rows. Candidates are dealt evenly into groups of at most GROUP_ROWS, whatever
their ids; a copy of every query goes to every group, behind the group's candidates. A task keeps one group
as postings (per term, the candidates that have it and their weights) and lets queries stream by: each of a
query's terms adds its weighted posting list to a dense array of scores, the k best are selected by
partition, and the groups' selections are merged in Spark. Nothing is pruned, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderlens.llm.common import claim

#: Candidates in a group at most; bounds a task's postings and the copies of a query alike.
GROUP_ROWS = 65_536
#: Fewer than this many candidates aren't worth a group of their own.
LEAST_ROWS = 4_096
#: Scores end there.
MOST, LEAST = (1 << 63) - 1, -(1 << 63)
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, term, weight): floor(scale * x) of each component as sparse rows. Vectors that are null or hold a
    null or non-finite component drop out, and rows without an id."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull() & whole).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q"))
    parts = F.filter(F.transform("q", lambda x, i: F.struct(i.alias("t"), x.alias("w"))), lambda p: p["w"] != 0)
    return rows.withColumn("p", parts).select("vec_id", F.col("p.t").alias("term"), F.col("p.w").alias("weight"))


class Group:
    """Candidates of one group as postings; ids ascend, so places order ties."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        self.ids, places = ids[order], np.repeat(rank, sizes)
        by_term = np.lexsort((places, terms))
        terms, places, weights = terms[by_term], places[by_term], weights[by_term]
        self.most, self.sum_most = _largest(weights), int(sizes.max(initial=0))
        found, first = np.unique(terms, return_index=True)
        self.postings = {}
        for t, p, w in zip(found.tolist(), np.split(places, first[1:]), np.split(weights, first[1:])):
            if 2 * len(p) >= len(ids):  # most have it: a dense row
                row = np.zeros(len(ids), dtype=np.int64)
                row[p] = w
                self.postings[t] = (None, row)
            else:
                self.postings[t] = (p, w)

    def scores(self, terms: list[int], weights: list[int]) -> np.ndarray:
        """The inner product of the query with every candidate, exact; beyond 64 bits it ends at their limits."""
        if self.most * max(map(abs, weights), default=0) * max(1, min(len(terms), self.sum_most)) > MOST:
            total = np.zeros(len(self.ids), dtype=object)
            for t, w in zip(terms, weights):
                if t in self.postings:
                    at, of = self.postings[t]
                    total[slice(None) if at is None else at] += of.astype(object) * w
            return np.array([min(max(x, LEAST + 1), MOST) for x in total], dtype=np.int64)
        total, spare = np.zeros(len(self.ids), dtype=np.int64), np.empty(len(self.ids), dtype=np.int64)
        for t, w in zip(terms, weights):
            if t in self.postings:
                at, of = self.postings[t]
                if at is None:
                    np.multiply(of, w, out=spare)
                    total += spare
                else:
                    total[at] += of * w
        return total

    def best(self, query: int, terms: list[int], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best but the query's own rows, ties to smaller ids."""
        total = self.scores(terms, weights)
        a, b = np.searchsorted(self.ids, [query, query + 1])
        ids = np.concatenate([self.ids[:a], self.ids[b:]]) if b > a else self.ids
        total = np.concatenate([total[:a], total[b:]]) if b > a else total
        if len(ids) > k:
            at = np.flatnonzero(total >= np.partition(total, len(ids) - k)[len(ids) - k])
            at = at[np.argsort(-total[at], kind="stable")][:k]
            ids, total = ids[at], total[at]
        return ids, total


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def top_k(vectors: DataFrame, asked: Column, k: int = 5, **columns: object) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asked`` (of vec_id) takes as a query, the k largest
    inner products with all other rows, ties to smaller ids.

    A query id that comes more than once is asked once, with its smallest vector, and its rows are no candidates of it;
    repeated candidates each count. Vectors may differ in length: missing components are 0. No query, no rows.
    """
    rows = quantised(vectors, **columns)
    n, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n // max(LEAST_ROWS, min(GROUP_ROWS, n // (2 * cores)))))
    candidates = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("asks"), "*")
    queries = rows.where(asked).groupBy("vec_id").agg(F.min(F.struct("term", "weight")).alias("v")).select("vec_id", "v.*")
    copies = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("asks"), "vec_id", "term", "weight")
    dealt = candidates.union(copies).repartition(groups, "g").sortWithinPartitions("g", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("topk")
        now, waiting, group = None, [], None
        for batch in batches:
            numbers, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "asks", "vec_id"))
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if a == b:
                    continue
                if numbers[a] != now:
                    now, waiting, group = numbers[a], [], None
                part = batch.slice(a, b - a)
                sizes, terms = _lists(part.column("term"))
                weights = _lists(part.column("weight"))[1]
                if not asks[a]:
                    waiting.append((ids[a:b], sizes, terms, weights))
                    continue
                if group is None:
                    if not waiting:
                        continue  # a group without candidates
                    group, waiting = Group(*(np.concatenate(x) for x in zip(*waiting))), []
                ends = np.cumsum(sizes).tolist()
                best = [group.best(q, terms[e - s : e].tolist(), weights[e - s : e].tolist(), k) for q, s, e in zip(ids[a:b].tolist(), sizes.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], [len(x[0]) for x in best])), pa.array(np.concatenate([x[0] for x in best])), pa.array(np.concatenate([x[1] for x in best]))], names=["query_id", "vec_id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = dealt.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every row whose vec_id is divisible by 50 against all other rows of embeddings; see ``top_k``
    and ``quantised`` for nulls, repeated rows and unlike lengths. Other columns are not read."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5"""
