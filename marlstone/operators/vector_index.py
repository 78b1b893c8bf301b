"""An inverted-file index of vectors: cells around centroids, of which a search reads a few.

Centroids are fitted on a bounded sample; every vector is written to the cell of
its nearest one, and cells are folders, so that a search's probes become partition
filters of the scan. Probes are chosen by measuring: of the nearest neighbours of
some indexed rows, how many lie in the first p cells. A search can also be exact:
angles within a cell are bounded by its radius, so after the first probes only cells
that may still hold something nearer are read.

Bounds: at most MOST_CELLS centroids, which tasks and the driver hold; SAMPLE rows
for the fit, PROBE_SAMPLE rows for the choice of probes. A cell of many rows is
written in several files. Searches take a stated set of queries, QUERY_BLOCK at a
time; each block's hits are written before the next block is read.

Defined results: rows without length (null, zero, or with null entries) are not
indexed and such queries find nothing; an index has one dimension, the first row's
unless it is given, and rows of others are left out; queries of another dimension
are an error. Ties, after rounding to six places, go to the smaller id; repeated rows
of one id are all indexed. An empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType

from marlstone.operators.tables import scratch, written

MOST_CELLS = 4096
SAMPLE, PROBE_SAMPLE = 50_000, 256
ROWS_A_FILE = 200_000
QUERY_BLOCK = 2048
#: Share of true neighbours that the chosen probes find.
RECALL = 0.95
#: Similarities are rounded to six places; what may tie after rounding is read.
SLACK = 2e-6


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class VectorIndex:
    """What a reader needs: the folder, the centroids, how far each cell reaches (in radians), how many rows it has, and the probes to take."""

    spark: SparkSession
    path: str
    id_type: DataType
    centroids: np.ndarray
    radii: np.ndarray
    rows: np.ndarray
    probes: int

    @staticmethod
    def build(rows: DataFrame, path: str | None = None, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None, dimensions: int | None = None, k: int = 20, recall: float = RECALL) -> VectorIndex:
        """cells: as many as the square root of the rows, at most MOST_CELLS, if not given."""
        spark = rows.sparkSession
        path = path or scratch(spark, "vector-index", keep=False)
        v = F.col(vector_col).cast("array<double>")
        own = rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.exists("v", lambda x: F.abs(x) > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        if dimensions is None:
            first = own.select(F.size("v").alias("d")).first()
            dimensions = first.d if first else 0
        own = written(own.where(F.size("v") == dimensions).select("id", _unit(F.col("v")).alias("v")), "unit-vectors")
        n = own.count()
        cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
        centroids = _centroids(own, n, cells) if n else np.zeros((0, dimensions))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _matrix(batch.column(1), dimensions) @ centroids.T
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "v", "cell", "angle"])

        schema = StructType([*own.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
        placed = written(own.mapInArrow(assign, schema), "placed-vectors") if n else spark.createDataFrame([], schema)
        sizes = {r.cell: (r.n, r.far) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far")).collect()}  # a row for each cell
        files = F.create_map(*[F.lit(x) for c, (m, _) in sizes.items() for x in (c, -(-m // ROWS_A_FILE))]) if sizes else None
        part = F.pmod(F.xxhash64("id"), files[F.col("cell")]) if sizes else F.lit(0)
        placed.withColumn("part", part).repartition("cell", "part").drop("part", "angle").write.mode("overwrite").partitionBy("cell").parquet(path)
        counts, radii = (np.array([sizes.get(c, (0, 0.0))[x] for c in range(len(centroids))]) for x in (0, 1))
        index = VectorIndex(spark, path, own.schema["id"].dataType, centroids, radii, counts, len(centroids))
        return replace(index, probes=index._probes_for(own, k, recall))

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    def vectors(self) -> DataFrame:
        """id, v and cell of all rows; cell is the partition."""
        return self.spark.read.schema(StructType().add("id", self.id_type).add("v", ArrayType(DoubleType())).add("cell", IntegerType())).parquet(self.path)

    def cells_of(self, queries: np.ndarray) -> np.ndarray:
        """Cells of each query (unit vectors), nearest first."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")

    def _probes_for(self, own: DataFrame, k: int, recall: float) -> int:
        """The fewest probes that find the wanted share of the true neighbours of a sample of rows."""
        if len(self.centroids) < 2:
            return len(self.centroids)
        sample = own.orderBy(F.xxhash64("id", "v"), "id").limit(PROBE_SAMPLE).collect()
        q = np.array([r.v for r in sample])
        order = np.argsort(self.cells_of(q), axis=1)  # place of each cell in a query's order
        hits = self._scan(list(range(len(sample))), q, k, None, IntegerType()).select("query_id", "cell").collect()  # k rows for each of the sample
        places = np.sort(np.array([order[r.query_id, r.cell] for r in hits]))
        return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1

    def _scan(self, names: list, q: np.ndarray, k: int, probed: np.ndarray | None, query_type: DataType) -> DataFrame:
        """query_id, id, similarity, cell, vector_rank. probed: queries x cells, True where a query reads a cell; all cells without it."""
        width, table = self.dimensions, self.vectors()
        if probed is not None:
            table = table.where(F.col("cell").isin(np.flatnonzero(probed.any(0)).tolist()))
        id_type, name_type = to_arrow_type(self.id_type), to_arrow_type(query_type)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, list] = {}
            for batch in batches:
                ids, cells = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy(zero_copy_only=False)
                v = _matrix(batch.column(1), width)
                for c in np.unique(cells):
                    at = np.flatnonzero(cells == c)
                    asking = np.arange(len(q)) if probed is None else np.flatnonzero(probed[:, c])
                    s = np.round(q[asking] @ v[at].T, 6)
                    for row, i in enumerate(asking.tolist()):
                        good = np.arange(len(at)) if len(at) <= k else np.flatnonzero(s[row] >= np.partition(s[row], -k)[-k])
                        kept[i] = sorted([*kept.get(i, []), *zip((-s[row][good]).tolist(), ids[at[good]].tolist(), [int(c)] * len(good))])[:k]
            flat = [(names[i], x, -s, c) for i, own in kept.items() for s, x, c in own]
            if flat:
                cols = list(zip(*flat))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], name_type), pa.array(cols[1], id_type), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], ["query_id", "id", "similarity", "cell"])

        return _ranked(table.mapInArrow(best, self._hits(query_type).add("cell", IntegerType())), k)

    def _hits(self, query_type: DataType) -> StructType:
        return StructType().add("query_id", query_type).add("id", self.id_type).add("similarity", DoubleType())

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, id, similarity, vector_rank of the k nearest rows in the first cells of each query; with exact, of all rows.

        queries: query_id, embedding.
        """
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")).where(F.exists("v", lambda x: F.abs(x) > 0))
        query_type = asked.schema["query_id"].dataType
        out = scratch(self.spark, "vector-hits", keep=False)
        schema = self._hits(query_type).add("vector_rank", IntegerType())
        self.spark.createDataFrame([], schema).write.parquet(out)
        n = asked.count() if len(self.centroids) else 0
        blocks = max(-(-n // QUERY_BLOCK), 1)
        asked = asked if blocks == 1 else written(asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")), "vector-questions")
        for b in range(blocks if n else 0):
            rows = (asked if blocks == 1 else asked.where(F.col("block") == b)).collect()
            if not rows:
                continue
            if any(len(r.v) != self.dimensions for r in rows):
                raise ValueError(f"queries of other dimensions than the index's {self.dimensions}")
            names, q = [r.query_id for r in rows], np.array([r.v for r in rows], float)
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            order = self.cells_of(q)[:, : min(probes or self.probes, len(self.centroids))]
            probed = np.zeros((len(q), len(self.centroids)), bool)
            np.put_along_axis(probed, order, True, 1)
            found = self._scan(names, q, k, probed, query_type)
            if exact:
                found = written(found, "first-hits")
                more = self._still(names, q, k, probed, found)
                if more.any():
                    found = _ranked(found.drop("vector_rank").unionByName(self._scan(names, q, k, more, query_type).drop("vector_rank")), k)
            found.drop("cell").write.mode("append").parquet(out)
        return self.spark.read.schema(schema).parquet(out)

    def _still(self, names: list, q: np.ndarray, k: int, probed: np.ndarray, found: DataFrame) -> np.ndarray:
        """Cells that may hold a row as near as a query's k-th hit, or that a query with fewer hits has not read."""
        last = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).collect()  # a row for each query of the block
        least = {r.query_id: r.least for r in last if r.n >= k}
        bar = np.array([least.get(x, -2.0) for x in names])
        angle = np.arccos(np.clip(q @ self.centroids.T, -1, 1))
        nearest = np.cos(np.maximum(angle - self.radii, 0))  # the most that a row of the cell can have
        return (nearest >= bar[:, None] - SLACK) & ~probed & (self.rows > 0)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)


def _centroids(own: DataFrame, n: int, cells: int) -> np.ndarray:
    """Unit centroids, fitted on at most SAMPLE rows."""
    sample = own if n <= SAMPLE else own.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < F.lit(int((1 << 20) * SAMPLE / n))).limit(SAMPLE)
    sample = written(sample.select(array_to_vector("v").alias("features")), "vector-sample")
    fitted = KMeans(k=cells, maxIter=8, initMode="random", seed=7, distanceMeasure="cosine").fit(sample)
    c = np.array([x for x in fitted.clusterCenters()], float)
    return c / np.linalg.norm(c, axis=1, keepdims=True)
