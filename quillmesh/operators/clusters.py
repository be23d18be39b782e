"""Exact nearest vectors from clusters on disk: a query reads the clusters that the triangle inequality leaves.

Vectors go to the nearest of some pivots, rows of the table themselves, and are stored by pivot. A cluster's radius bounds
how near a query can come to its members. A search reads the clusters around the query until it has k rows, and then all
those that may hold something nearer than the k-th."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import filesystem


@dataclass(frozen=True)
class Found:
    """rows (id, distance or cosine), the best first; the clusters that were read, and how many there are."""

    rows: DataFrame
    read: int
    clusters: int


def _unit(v: Column) -> Column:
    n = text.norm(v)
    return F.when(n > 0, F.transform(F.array(n), lambda m: F.transform(v, lambda x: x / m))[0]).otherwise(v)


def write(vectors: DataFrame, path: str, pivots: int = 64, metric: str = "l2") -> None:
    """Store vectors (id, vector; nulls are left out) below path, in clusters. For cosine, clusters are of directions.

    All vectors must have one length. The pivots (a bounded number) go through the driver and to the tasks; each row is
    compared with them, and shuffled once."""
    if metric not in ("l2", "cosine"):
        raise ValueError("the metric is l2 or cosine")
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    place = _unit(F.col("vector")) if metric == "cosine" else F.col("vector")
    some = rows.select(place.alias("v"), "id").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(pivots).collect()
    centres = [list(c) for c in dict.fromkeys(tuple(r.v) for r in some)]
    spark = vectors.sparkSession
    sent = spark.createDataFrame([(centres,)], "_centres array<array<double>>")  # a row, of a bounded number of vectors
    near = F.transform("_centres", lambda c, i: F.struct(text.squared_l2(F.col("_v"), c).alias("d"), i.alias("i")))
    dealt = rows.withColumn("_v", place).crossJoin(F.broadcast(sent)).withColumn("_near", F.array_min(near))
    dealt = dealt.select("id", "vector", F.sqrt("_near.d").alias("off"), F.col("_near.i").alias("cluster"))
    dealt.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
    held = spark.read.schema("id string, off double, cluster int").parquet(f"{path}/rows") if centres else None
    size = {r.cluster: (r.n, r.r) for r in held.groupBy("cluster").agg(F.count("*").alias("n"), F.max("off").alias("r")).collect()} if held is not None else {}
    kept = [{"cluster": i, "centre": c, "rows": size[i][0], "radius": size[i][1]} for i, c in enumerate(centres) if i in size]
    fs, at = filesystem(spark, f"{path}/clusters.json")
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(json.dumps({"metric": metric, "id": dict(rows.dtypes)["id"], "clusters": kept}).encode()))
    finally:
        stream.close()


def search(spark: SparkSession, path: str, query: list[float], k: int) -> Found:
    """The k nearest to a vector, ties by id; the same rows as a scan of all vectors gives."""
    fs, at = filesystem(spark, f"{path}/clusters.json")
    stream = fs.open(at)
    try:
        stored = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    cosine, clusters = stored["metric"] == "cosine", stored["clusters"]
    name = "cosine" if cosine else "distance"
    if not clusters or k < 1:
        return Found(spark.createDataFrame([], f"id {stored['id']}, {name} double"), 0, len(clusters))
    if len(query) != len(clusters[0]["centre"]):
        raise ValueError(f"vectors have {len(clusters[0]['centre'])} components, the query {len(query)}")
    size = math.sqrt(sum(x * x for x in query))
    own = [x / size for x in query] if cosine and size else query
    # The least distance that a member can have; a little less, for the rounding.
    least = {c["cluster"]: math.dist(own, c["centre"]) - c["radius"] - 1e-9 * (1 + c["radius"]) for c in clusters}
    rows = spark.read.schema(f"id {stored['id']}, vector array<double>, cluster int").parquet(f"{path}/rows")
    given = F.array(*map(F.lit, query)).cast("array<double>")
    value = text.cosine(F.col("vector"), given) if cosine else text.squared_l2(F.col("vector"), given)
    order = [F.desc(name) if cosine else F.asc(name), F.asc("id")]

    def best(of: list[int]) -> DataFrame:
        return rows.where(F.col("cluster").isin(of)).select("id", value.alias(name)).orderBy(*order).limit(k)

    first, n = [], 0
    for c in sorted(clusters, key=lambda c: least[c["cluster"]]):
        if n >= k:
            break
        first.append(c["cluster"])
        n += c["rows"]
    worst = [r[1] for r in best(first).collect()][k - 1 :]  # of k rows
    if not worst:
        wanted = [c["cluster"] for c in clusters]
    elif cosine:
        # Directions at distance d have a cosine of 1 - d^2 / 2. Vectors without one have a cosine of 0 and stand at a
        # distance of 1: where they may count, the reach is beyond that.
        reach = math.inf if not size else math.sqrt(max(0.0, 2 - 2 * worst[0])) + 1e-7
        wanted = [c["cluster"] for c in clusters if least[c["cluster"]] <= reach]
    else:
        wanted = [c["cluster"] for c in clusters if least[c["cluster"]] <= math.sqrt(worst[0]) + 1e-9]
    return Found(best(wanted), len(wanted), len(clusters))
