"""Shortest paths over edge tables (u, v, w); every round is a join and an aggregation over a written table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(df: DataFrame) -> DataFrame:
    """A table in the folder of spark.checkpoint.dir, so that lineage doesn't grow and lost executors lose nothing."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def edges_of(df: DataFrame, u: str, v: str, w: str | None = None, edge_id: str | None = None) -> DataFrame:
    """(edge_id, u, v, w); a negative weight is an error, a missing one 1."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    weight = F.when(weight < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(weight)
    return df.select(*([F.col(edge_id).alias("edge_id")] if edge_id else []), F.col(u).alias("u"), F.col(v).alias("v"), weight.alias("w"))


def with_coordinates(edges: DataFrame, vertices: DataFrame, vertex: str = "id", coords: str = "coords") -> DataFrame:
    """Edges whose weight is the Euclidean length between the ends' coordinates times their weight."""
    a, b = (vertices.select(F.col(vertex).alias(k), F.col(coords).alias(f"_{k}")) for k in ("u", "v"))
    length = F.sqrt(F.aggregate(F.zip_with("_u", "_v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    return edges.join(a, "u").join(b, "v").withColumn("w", F.col("w") * length).drop("_u", "_v").select(edges.columns)


def last_wins(edges: DataFrame) -> DataFrame:
    """One edge for each (u, v): that with the largest edge_id."""
    return edges.groupBy("u", "v").agg(F.max_by("w", "edge_id").alias("w"), F.max("edge_id").alias("edge_id")).select("edge_id", "u", "v", "w")


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def n_vertices(edges: DataFrame) -> int:
    return vertices_of(edges).count()


def neighbours(edges: DataFrame) -> DataFrame:
    """(u, out): targets of the outgoing edges in edge order, repeated ones kept."""
    return edges.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "v"))), lambda x: x["v"]).alias("out"))


def edge(edges: DataFrame, edge_id: int) -> DataFrame:
    return edges.filter(F.col("edge_id") == edge_id)


def all_pairs(edges: DataFrame, hops: bool = False) -> DataFrame:
    """(i, j, dist) of all reachable pairs and of each vertex with itself, by min-plus squaring: the number of rounds is
    the logarithm of the longest path. With hops all weights are 1."""
    one = edges.select("u", "v", (F.lit(1.0) if hops else F.col("w")).alias("w")).groupBy("u", "v").agg(F.min("w").alias("dist"))
    own = vertices_of(edges).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("dist"))
    d = own.unionByName(one.filter("u <> v").select(F.col("u").alias("i"), F.col("v").alias("j"), "dist"))
    d = _written(d)
    before = None
    while True:
        left, right = d.select("i", F.col("j").alias("m"), F.col("dist").alias("a")), d.select(F.col("i").alias("m"), "j", F.col("dist").alias("b"))
        d = _written(left.join(right, "m").groupBy("i", "j").agg(F.min(F.col("a") + F.col("b")).alias("dist")))
        now = d.agg(F.count("*"), F.sum("dist")).first()
        if before is not None and now[0] == before[0] and abs(now[1] - before[1]) <= 1e-12 * max(1.0, abs(now[1])):
            return d
        before = now


def distance_grid(edges: DataFrame) -> DataFrame:
    """(i, j, dist) of every pair of vertices; unreachable pairs are infinite."""
    d, v = all_pairs(edges), vertices_of(edges)
    grid = v.select(F.col("id").alias("i")).crossJoin(v.select(F.col("id").alias("j")))  # the result itself has a row per pair
    return grid.join(d, ["i", "j"], "left").withColumn("dist", F.coalesce("dist", F.lit(float("inf"))))


def shortest_from(edges: DataFrame, source, hops: bool = False) -> DataFrame:
    """(v, dist, prev) of every vertex that the source reaches; rounds relax only what the last one improved.

    Among predecessors with equal distances the least is kept; the source has none.
    """
    e = _written(edges.select("u", "v", (F.lit(1.0) if hops else F.col("w")).alias("w")).groupBy("u", "v").agg(F.min("w").alias("w")))
    kind = edges.schema["u"].dataType.simpleString()
    known = _written(edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("v"), F.lit(0.0).alias("dist"), F.lit(None).cast(kind).alias("prev")))
    front = known
    while not front.isEmpty():
        step = front.withColumnRenamed("v", "u").drop("prev").join(e, "u").select("v", (F.col("dist") + F.col("w")).alias("dist"), F.col("u").alias("prev"))
        step = step.groupBy("v").agg(F.min(F.struct("dist", "prev")).alias("s")).select("v", "s.dist", "s.prev")
        old = known.select("v", F.col("dist").alias("_d"))
        front = _written(step.join(old, "v", "left").filter("_d IS NULL OR dist < _d").drop("_d"))
        known = _written(known.join(front.select("v"), "v", "left_anti").unionByName(front))
    return known


def path_to(known: DataFrame, source, target) -> list:
    """Vertices from source to target; [source] for itself, none where there is no way. Reads one row per step."""
    if source == target:
        return [source]
    out, at = [target], target
    while at != source:
        row = known.filter(F.col("v") == F.lit(at)).select("prev").first()
        if row is None or row.prev is None:
            return []
        at = row.prev
        out.append(at)
    return out[::-1]


def matrix_text(grid: DataFrame) -> str:
    """A small grid of distances as text, rows and columns in vertex order."""
    rows: dict = {}
    for r in grid.orderBy("i", "j").collect():
        rows.setdefault(r.i, []).append(f"{r.dist:g}")
    return "[" + ", ".join("[" + ", ".join(x) + "]" for x in rows.values()) + "]"
