"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash of a unit vector is its nearest signed axis after a fast pseudo-rotation: three rounds of random signs and a
Hadamard transform. A query probes the axes nearest to it in several tables; the vectors found there are scored exactly.
Vectors are indexed by ranges of norm, each 5 % wide, so that within a range the largest inner product has nearly the smallest
angle; a query probes every range. Ranges of few vectors, and queries for which too few vectors were found, are scored
exactly in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

TABLES, PROBES, BUCKET_ROWS = 14, 7, 4_096
RANGE, EXACT_ROWS, QUERY_ROWS = 1.05, 4_096, 2_048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, which: int, seed: int) -> np.ndarray:
    """Pseudo-rotation ``which`` of each row, padded to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, which]).choice([-1.0, 1.0], (3, width))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray, which: int, seed: int, probes: int = 1) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row: axis i as i, its negative as i + width."""
    y = rotate(x, which, seed)
    both = np.concatenate([y, -y], axis=1)
    probes = min(probes, both.shape[1])
    return np.argpartition(-both, probes - 1, axis=1)[:, :probes] if probes < both.shape[1] else np.tile(np.arange(both.shape[1]), (len(x), 1))


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) whose vector is not null, not empty, not zero and holds finite components only."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def nearest(df: DataFrame, is_query: F.Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, seed: int = 8) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``df`` (vec_id, v) that ``is_query`` selects, the ``k`` largest inner products with
    other rows, nearest first, ties to the smaller vec_id.

    Equal vectors are indexed once, with their k + 1 smallest ids: no more of them can be among the nearest of any
    query. A bucket of over 4,096 vectors is dealt over several tasks, each of which gets the bucket's queries. A range of norms
    with at most 4,096 vectors is not hashed but scored whole; where more than one range is hashed, each is probed twice as
    often. Vectors of another length than most are searched among their own. An empty table gives no rows; repeated rows
    count once.
    """
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(32))
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    groups = (
        df.groupBy("v", salt.alias("salt")).agg(least(F.collect_set("vec_id")).alias("ids"))
        .groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    )
    groups = materialize(groups.withColumn("n", F.size("v")), "ann_vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    top = groups.agg(F.max(norm).alias("m")).collect()[0]["m"] or 1.0
    groups = groups.withColumn("range", F.coalesce(F.floor((float(np.log(top)) - F.log(norm)) / float(np.log(RANGE))), F.lit(-1)).cast("int"))
    # one row for each range of norms: bounded by what a double can hold, not by the rows
    cells = groups.groupBy("n", "range").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("ids")).collect()
    hashed_ranges: dict[int, list[int]] = {}
    for c in cells:
        if c["rows"] > EXACT_ROWS:
            hashed_ranges.setdefault(c["n"], []).append(c["range"])
    probes = 2 * probes if any(len(x) > 1 for x in hashed_ranges.values()) else probes
    wanted: dict[int, int] = {}
    for c in cells:
        wanted[c["n"]] = wanted.get(c["n"], -1) + c["ids"]

    def hashed(query: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for n, part in f.groupby("n"):
                    if n not in hashed_ranges:
                        continue
                    x = np.stack(part["v"].to_numpy()).astype(float)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.sqrt((x * x).sum(1, keepdims=True))
                    for t in range(tables):
                        a = axes(x, t, seed, probes if query else 1)
                        for j in range(a.shape[1]):
                            at = part.assign(bucket=(t << 20) | a[:, j].astype(np.int64))
                            for r in hashed_ranges[n] if query else [None]:
                                yield at.assign(range=r) if query else at

        return run

    many = F.broadcast(df.sparkSession.createDataFrame([(n, r) for n, rs in hashed_ranges.items() for r in rs], "n int, range int"))
    index_schema = "v array<double>, ids array<long>, n int, range int, bucket long"
    index = groups.join(many, ["n", "range"], "left_semi").select("v", "ids", "n", "range").mapInPandas(hashed(False), index_schema)
    asked = df.filter(is_query).dropDuplicates(["vec_id"]).select("vec_id", "v", F.size("v").alias("n"))
    asked = materialize(asked, "ann_queries")
    queries = asked.mapInPandas(hashed(True), "vec_id long, v array<double>, n int, bucket long, range int")
    # a bounded table: at most tables x 2 x width rows for each range of norms
    sizes = materialize(index.groupBy("n", "range", "bucket").count(), "ann_buckets")
    splits = F.broadcast(sizes.select("n", "range", "bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("splits")))
    index = index.join(splits, ["n", "range", "bucket"]).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("splits")).cast("int")).drop("splits")
    queries = queries.join(splits, ["n", "range", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")

    def rank(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(x):
            return empty
        vecs, ids = np.stack(x["v"].to_numpy()), x["ids"].to_numpy()
        out = []
        repeats = np.array([len(i) for i in ids])
        for i in range(0, len(q), 256):
            part = q.iloc[i : i + 256]
            scores = np.stack(part["v"].to_numpy()) @ vecs.T
            keep = min(k + 1, len(x))
            cut = np.partition(scores, len(x) - keep, axis=1)[:, len(x) - keep]
            r, c = np.nonzero(scores >= cut[:, None] - 1e-9)
            n = repeats[c]
            out.append(pd.DataFrame({"query_id": np.repeat(part["vec_id"].to_numpy()[r], n), "vec_id": np.concatenate([ids[j] for j in c]), "score": np.repeat(scores[r, c], n)}))
        got = pd.concat(out)
        got = got[got["query_id"] != got["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return got.groupby("query_id").head(k + 1)

    found_schema = "query_id long, vec_id long, score double"

    def in_blocks(q: DataFrame, x: DataFrame) -> DataFrame:
        """Every query against every vector of its length, in pairs of blocks."""
        qs, xs = (max(1, -(-d.count() // rows)) for d, rows in ((q, QUERY_ROWS), (x, BUCKET_ROWS)))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        q = q.select("vec_id", "v", "n", F.pmod(F.xxhash64("vec_id"), F.lit(qs)).cast("int").alias("qb")).withColumn("xb", every(xs))
        x = x.select("v", "ids", "n", F.pmod(F.xxhash64("ids"), F.lit(xs)).cast("int").alias("xb")).withColumn("qb", every(qs))
        return q.groupBy("n", "qb", "xb").cogroup(x.groupBy("n", "qb", "xb")).applyInPandas(rank, found_schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = in_blocks(asked, groups.join(many, ["n", "range"], "left_anti"))
    if hashed_ranges:
        on = ["n", "range", "bucket", "part"]
        found = found.union(queries.groupBy(*on).cogroup(index.groupBy(*on)).applyInPandas(rank, found_schema))
    found = materialize(ranked(found), "ann_found")
    if not hashed_ranges:
        return found
    enough = F.broadcast(df.sparkSession.createDataFrame([(n, min(k, w)) for n, w in wanted.items()], "n int, enough int"))
    got = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got"))
    short = materialize(asked.join(enough, "n").join(got, "vec_id", "left").filter(F.coalesce("got", F.lit(0)) < F.col("enough")).select("vec_id", "v", "n"), "ann_short")
    if short.isEmpty():
        return found
    rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return rest.select(found.columns).union(ranked(in_blocks(short, groups)))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
