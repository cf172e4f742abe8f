"""A corpus of workbooks: Parquet partitioned by content hash, with a manifest.

A workbook's rows are replaced as one partition (dynamic overwrite), so putting it again is the same
as putting it once; the manifest row is written last, and only what it names is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.search import normalised

VERSION = 1
#: Formula groups of a workbook beyond which the layer is left out.
MOST_GROUPS = 20_000
LAYERS = ("cells", "regions", "nodes", "edges", "groups", "docs", "vectors")


class Corpus:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workbook_hash").parquet(f"{self.root}/{name}")

    def put(self, workbook_hash: str, path: str, **layers: DataFrame) -> None:
        """Store layers of one workbook; a large formula-group layer is dropped and the flag recorded."""
        dropped = False
        for name, rows in layers.items():
            if name not in LAYERS:
                raise ValueError(f"no layer {name}")
            if name == "groups" and rows.count() > MOST_GROUPS:
                dropped = True
                continue
            self._write(name, rows.withColumn("workbook_hash", F.lit(workbook_hash)))
        sizes = layers["cells"].agg(F.count("*").alias("n_cells"), F.count_distinct("sheet_id").alias("n_sheets")).first() if "cells" in layers else (0, 0)
        row = [(workbook_hash, path, int(sizes[1]), int(sizes[0]), dropped, VERSION)]
        self._write("manifest", self.spark.createDataFrame(row, "workbook_hash string, path string, n_sheets long, n_cells long, groups_dropped boolean, version int"))

    def put_profiles(self, workbook_hash: str, rows: DataFrame) -> None:
        """Values live apart, so they can be withheld or deleted alone."""
        self._write("profiles", rows.withColumn("workbook_hash", F.lit(workbook_hash)))

    def put_vectors(self, workbook_hash: str, rows: DataFrame, model: str, dim: int) -> None:
        """Unit vectors (node, embedding) of one model; another width is refused."""
        wrong = rows.filter(F.size("embedding") != dim).limit(1).count()
        if wrong:
            raise ValueError(f"a vector is not of width {dim}")
        unit = rows.withColumn("embedding", normalised(F.col("embedding")).cast("array<float>"))
        self._write("vectors", unit.withColumns({"model": F.lit(model), "dim": F.lit(dim), "workbook_hash": F.lit(workbook_hash)}))

    def vectors(self, model: str, dim: int) -> DataFrame:
        """Vectors of this model alone; those of another are skipped."""
        return self.get("vectors").filter((F.col("model") == model) & (F.col("dim") == dim))

    def entries(self) -> DataFrame:
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], "path string, n_sheets long, n_cells long, groups_dropped boolean, version int, workbook_hash string")
        return self.spark.read.parquet(f"{self.root}/manifest").filter(F.col("version") == VERSION)

    def get(self, name: str, workbook_hash: str | None = None) -> DataFrame:
        """A layer of one workbook, or of all that the manifest names; another version is a miss."""
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        if workbook_hash is not None:
            return rows.filter(F.col("workbook_hash") == workbook_hash)
        return rows.join(F.broadcast(self.entries().select("workbook_hash")), "workbook_hash", "left_semi")

    def forget(self, workbook_hash: str) -> None:
        jvm = self.spark._jvm
        for name in ("manifest", "profiles", *LAYERS):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/workbook_hash={workbook_hash}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def resolve(self, which: str | None) -> str:
        """A hash, a prefix, a path or a file name; without one the only workbook there is."""
        rows = [(r.workbook_hash, r.path) for r in self.entries().select("workbook_hash", "path").collect()]
        if which is None:
            found = [h for h, _ in rows]
        else:
            found = [h for h, p in rows if h == which or p == which] or [h for h, p in rows if h.startswith(which) or p.rsplit("/", 1)[-1] == which]
        if len(found) != 1:
            raise LookupError(f"{'no' if not found else 'more than one'} workbook for {which!r}: {', '.join(p for _, p in rows)}")
        return found[0]
