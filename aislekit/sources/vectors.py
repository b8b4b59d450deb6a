"""Vector tables: an embedding beside the metadata of its product, stored by reference cell.

A store has two tables: `vectors`, sorted by cell with small row groups, so that a filter on cells reads few files and
of these few groups; and `cells`, a row for each cell, and each reference, with the angles of its vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit.operators.cells import Cells, References, assigned, cell_table, matrices, references_of

#: Bytes of a row group of the vectors.
GROUP_BYTES = 4 << 20


@dataclass(frozen=True)
class VectorStore:
    """Stored vectors: `rows` have a `cell` (null for vectors that cannot be compared), `cells` bound them."""

    rows: DataFrame
    cells: Cells

    def among(self, products: DataFrame) -> VectorStore:
        """Only the vectors of these products (product_id); bounds hold for fewer vectors too."""
        return replace(self, rows=self.rows.join(products.select("product_id"), "product_id", "left_semi"))

    def of_cells(self, wanted: list[int]) -> DataFrame:
        """The rows of some cells; the filter reaches the files."""
        return self.rows.where(F.col("cell").isin([int(c) for c in wanted])) if wanted else self.rows.limit(0)


def write_vectors(df: DataFrame, path: str, key: str = "product_id", kind: str = "float") -> None:
    """Write a store of the rows of `df`, whose `embedding` becomes an array of `kind`.

    Equal cells may be in several files, so a cell of very many vectors is no single task.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    df = df.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    references = references_of(df, key)
    rows = assigned(df, references)
    rows = rows.repartitionByRange("cell", F.xxhash64(key)).sortWithinPartitions("cell", key)
    rows.write.option("parquet.block.size", str(GROUP_BYTES)).parquet(f"{path}/vectors")
    table = cell_table(spark.read.parquet(f"{path}/vectors"))
    drawn = [(int(c), u.tolist()) for numbers, units in references.by_length.values() for c, u in zip(numbers, units)]
    drawn = spark.createDataFrame(drawn, "cell bigint, reference array<double>")  # as many as references, see cells.NUMBERS
    table.join(drawn, "cell", "full").coalesce(1).write.parquet(f"{path}/cells")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The rows as they were written."""
    return spark.read.parquet(f"{path.rstrip('/')}/vectors").drop("cell", "angle")


def open_vectors(spark: SparkSession, path: str) -> VectorStore:
    """A store for searches. Its cells are read at once: a row for each reference, and one for each length without any."""
    path = path.rstrip("/")
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    column = table.column("reference").combine_chunks()
    numbers = np.asarray(table.column("cell"))
    by_length = {size: (numbers[at], units) for size, at, units in matrices(column)}
    known = {r["cell"]: (r["low"], r["high"], r["rows"]) for r in table.select(["cell", "low", "high", "rows"]).to_pylist() if r["rows"]}
    return VectorStore(spark.read.parquet(f"{path}/vectors"), Cells(References(by_length), known))
