"""A store of named arrays of one to three dimensions with attributes, as Parquet; and the interfaces that are only stubs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ArrayStore:
    """Datasets under a folder: coordinates and values in columns, attributes in the schema's metadata."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, name: str, cells: DataFrame, dims: int, attributes: dict[str, float] | None = None) -> None:
        """cells: (i[, j[, k]], val)."""
        axes = ["i", "j", "k"][:dims]
        if not 1 <= dims <= 3:
            raise ValueError("1 to 3 dimensions")
        out = cells.select(*axes, F.col("val").cast("double").alias("val")).withMetadata("val", dict(attributes or {}))
        out.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def shape(self, name: str) -> tuple[int, ...]:
        df = self.read(name)
        row = df.agg(*(F.max(c) for c in df.columns if c != "val")).first()
        return tuple(int(x) + 1 for x in row)

    def attributes(self, name: str) -> dict[str, float]:
        return dict(self.read(name).schema["val"].metadata)

    def attribute(self, name: str, key: str) -> float:
        return self.attributes(name)[key]


def _stub(what: str):
    class Stub:
        """Every operation is unavailable."""

        def __init__(self, *args, **kwargs):
            pass

        def __getattr__(self, name: str):
            def missing(*args, **kwargs):
                raise NotImplementedError(f"{what}: {name} isn't available; Spark is the execution backend")

            return missing

    Stub.__name__ = what
    return Stub


H5File, Mpi, CudaDevice, CudaBackend, VulkanDevice, VulkanBackend, OpenClDevice, OpenClBackend = (_stub(x) for x in ("H5File", "Mpi", "CudaDevice", "CudaBackend", "VulkanDevice", "VulkanBackend", "OpenClDevice", "OpenClBackend"))


def compute_backend(name: str = "auto") -> str:
    """The one backend there is; any other isn't implemented."""
    if name in ("auto", "cpu"):
        return "spark"
    raise NotImplementedError(f"backend {name}")


def reshape(flat: Sequence[float], rows: int, cols: int) -> list[list[float]]:
    if len(flat) != rows * cols or not rows or not cols:
        raise ValueError("the length isn't rows times columns")
    return [list(flat[r * cols : (r + 1) * cols]) for r in range(rows)]
