"""Whitening of embeddings: principal components of centred rows, scaled to unit variance.

Entries become integers first, so counts, sums and squared deviations are exact.
MLlib's computeSVD runs over the centred rows as a distributed RowMatrix: executors
sum the Gramian, and the driver decomposes that one d x d matrix. A singular value s
stands for the eigenvalue s * s / n of the covariance with divisor n. The total
variance that shares are taken of comes from the exact deviations, not from the
decomposition, and the covariance of the whitened rows is measured afterwards.

All singular vectors are asked for, as the decomposition of the whole Gramian is
exact to double precision where the iteration for a few of them stops at a tolerance.

Skew and size: rows are scanned in place and never shuffled; aggregates are d sums
and the Gramian, whose size depends on the dimension alone.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are dropped. A space has one dimension, so where lengths differ the most
frequent one (of equally frequent ones the longest) is taken and other rows have no
place in it. Repeated rows and null or repeated ids each keep their rows. Components
without variance (constant columns, fewer rows than components, one row) cannot be
scaled and give no rows; an empty table gives none. An entry whose integer a bigint
cannot hold is an error. Only the two named columns are
read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import load, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Singular values below this share of the largest are noise: their squares, the eigenvalues, have a share under 1e-14.
LEAST_SHARE = 1e-7
#: Exact sums of squares outgrow a bigint with a few hundred thousand rows.
EXACT = "decimal(38,0)"


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and x (array of bigint) of the rows that have a place in the space."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    rows = embeddings.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), x.alias("x"))
    rows = written(rows, "vectors")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


@dataclass(frozen=True)
class Space:
    """What a fit list says: its size, sums, and components with their eigenvalues and shares."""

    n: int
    sums: tuple[int, ...]
    components: tuple[tuple[float, ...], ...]
    eigenvalues: tuple[float, ...]
    explained: tuple[float, ...]

    def centred(self, x: Column) -> Column:
        means = F.array(*[F.lit(s / self.n) for s in self.sums])
        return F.zip_with(x, means, lambda a, m: a - m)

    def deviation(self, x: Column) -> Column:
        """Sum over dimensions of (n x - S)^2, exact."""
        of = F.zip_with(x, F.array(*[F.lit(s).cast("bigint") for s in self.sums]), lambda a, s: F.lit(self.n).cast("bigint") * a - s)
        # a product of two 19-digit integers fits; adding keeps 38 digits and raises an error beyond them
        square = lambda d: (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast(EXACT)
        return F.aggregate(of, F.lit(0).cast(EXACT), lambda total, d: (total + square(d)).cast(EXACT))

    def whitened(self, x: Column) -> Column:
        """Array of the coordinates along the components, each of variance one over the fit list."""

        def along(c: tuple[float, ...], e: float) -> Column:
            products = F.zip_with(self.centred(x), F.array(*[F.lit(k) for k in c]), lambda a, b: a * b)
            return F.aggregate(products, F.lit(0.0), lambda total, p: total + p) / F.lit(e**0.5)

        return F.array(*[along(c, e) for c, e in zip(self.components, self.eigenvalues)]) if self.components else F.array().cast("array<double>")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Space:
    """The space of rows (x: arrays of one length)."""
    first = rows.select(F.size("x").alias("d")).first()
    d = first.d if first else 0
    n, *sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k].cast(EXACT)) for k in range(d)]).first()
    bare = Space(n, tuple(map(int, sums)), (), (), ())
    if n < 2:
        return bare
    deviations = rows.agg(F.sum(bare.deviation(F.col("x")))).first()[0]
    if not deviations:
        return bare
    centred = rows.select(array_to_vector(bare.centred(F.col("x"))).alias("row"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, d)
    svd = matrix.computeSVD(d, computeU=False, rCond=LEAST_SHARE)
    values, vectors = svd.s.toArray(), svd.V.toArray()
    kept = range(min(components, len(values)))
    trace = int(deviations) / n**3  # exact integers until the last division
    eigenvalues = tuple(float(values[k] ** 2 / n) for k in kept)
    return Space(n, bare.sums, tuple(tuple(map(float, vectors[:, k])) for k in kept), eigenvalues, tuple(e / trace for e in eigenvalues))


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred before multiplying) of w minus the identity."""
    pairs = list(combinations_with_replacement(range(components), 2))
    if not pairs:
        return 0.0
    found = whitened.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c_{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Space, float]:
    """id, deviation (decimal) and w of each row with a place in the space; the space; how far the covariance of w is from the identity."""
    rows = integers(embeddings, id_col, vector_col)
    space = fit(rows, components)
    found = written(rows.select("id", space.deviation(F.col("x")).alias("deviation"), space.whitened(F.col("x")).alias("w")), "whitened")
    return found, space, identity_error(found, len(space.components))


def op13_whitening_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is a bigint here; rows beyond its range are an error."""
    found, space, error = whiten(load(spark, sf_dir, "embeddings"))
    shares = F.array(*[F.lit(e) for e in space.explained]) if space.explained else F.array().cast("array<double>")
    each = found.select(F.col("id").alias("vec_id"), F.col("deviation").cast("bigint").alias("deviation"), F.posexplode(F.arrays_zip(F.col("w"), shares.alias("e"))).alias("k", "c"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(space.n).cast("bigint").alias("n"), "deviation", F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), F.lit(error).alias("identity_error"))
