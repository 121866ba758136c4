"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector becomes a code of 64 signs, cut into segments. The index lists distinct codes by segment value. A query's
segments are probed at growing radius r; after radius r every code within distance m*(r+1)-1 of m segments has been seen,
so a query is done once its kth verified distance is within that. Others go on with r+1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._store import written

CODE_BITS = 64


def codes(vectors: DataFrame, seed: int = 6) -> DataFrame:
    """(vec_id, code): bit b is the sign of the vector's product with the bth random direction; vectors without values are left out."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.array([0.0 if e is None else e for e in v.as_py() or ()], float)
                if not len(x) or i is None:
                    continue
                if len(x) not in planes:
                    planes[len(x)] = np.linalg.qr(np.random.default_rng([seed, len(x)]).standard_normal((max(len(x), CODE_BITS),) * 2))[0][: len(x), :CODE_BITS]
                bits = np.nan_to_num(x) @ planes[len(x)] > 0
                ids.append(i)
                out.append(np.packbits(bits).view(">i8")[0])
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "code": pa.array(out, pa.int64())})

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(sign, "vec_id long, code long")


def segment(code: Column, number: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", code, (number * bits).cast("int")).bitwiseAND((1 << bits) - 1).cast("int")


def top_k(items: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """The k nearest other items of every query by Hamming distance, then id: query_id, rank, vec_id, distance.

    `items`, `queries`: vec_id, code. A query's own id is not among its neighbours. A query with fewer than k others
    gets them all. Equal codes are one entry of the index, with their k+1 smallest ids, which is all that any answer can need;
    so many copies of one vector cost one code. Repeated (vec_id, code) rows count once. Empty items or queries give no rows.
    """
    bits = CODE_BITS // segments
    items = items.select("vec_id", "code").distinct()
    nth = F.row_number().over(W.partitionBy("code").orderBy("vec_id"))
    entries = items.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    entries = written(entries, "entries")
    listed = entries.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k+1 ids
    number = F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))
    index = listed.select("code", "ids", number.alias("number"))
    index = written(index.withColumn("value", segment(F.col("code"), F.col("number"), bits)), "index")
    asked = written(queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query_code")).distinct(), "asked")
    open_codes = asked.select("query_code").distinct()
    found = None
    answers = []
    spark = items.sparkSession
    for r in range(bits + 1):
        masks = [sum(1 << b for b in c) for c in combinations(range(bits), r)]
        flips = spark.createDataFrame([(masks,)], "masks array<int>")
        probes = open_codes.select("query_code", number.alias("number")).join(F.broadcast(flips))  # one row
        probes = probes.select("query_code", "number", F.explode("masks").alias("mask"))
        probes = probes.select("query_code", "number", segment(F.col("query_code"), F.col("number"), bits).bitwiseXOR(F.col("mask")).alias("value"))
        distance = F.bit_count(F.col("query_code").bitwiseXOR(F.col("code")))
        new = probes.join(index, ["number", "value"]).select("query_code", "code", distance.cast("int").alias("distance"), "ids").distinct()
        seen = new if found is None else found.unionByName(new).distinct()
        # nearest codes whose ids suffice: those with fewer than k+1 ids before them
        before = W.partitionBy("query_code").orderBy("distance", F.element_at("ids", 1))
        ranked = seen.withColumn("nth", F.row_number().over(before)).where(F.col("nth") <= k + 1).drop("nth")
        ranked = written(ranked, "nearest")
        flat = ranked.select("query_code", "distance", F.explode("ids").alias("vec_id"))
        kth = W.partitionBy("query_code").orderBy("distance", "vec_id")
        reach = flat.withColumn("nth", F.row_number().over(kth)).where(F.col("nth") == k + 1).where(F.col("distance") <= segments * (r + 1) - 1)
        done = open_codes.join(reach.select("query_code"), "query_code", "left_semi") if r < bits else open_codes
        answers.append(written(ranked.join(done, "query_code", "left_semi"), "answers"))
        if r < bits:
            open_codes = written(open_codes.join(reach.select("query_code"), "query_code", "left_anti"), "open")
            found = ranked.join(open_codes, "query_code", "left_semi")
            if open_codes.isEmpty():
                break
    near = answers[0]
    for more in answers[1:]:
        near = near.unionByName(more)
    nth = F.row_number().over(W.partitionBy("query_code").orderBy("distance", "vec_id"))
    near = near.select("query_code", "distance", F.explode("ids").alias("vec_id")).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    pairs = asked.join(near, "query_code").where("vec_id <> query_id").select("query_id", "distance", "vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
