"""A stored search index: postings by hash of their term, and vectors that are embedded once.

Each put of a workbook writes a version of its own: folders that are never changed afterwards. The
workbook's manifest row, written last, names the version that counts, so readers see a workbook whole
and putting it again replaces it; what no manifest row names is not read.

A question reads the postings of its terms alone: the bucket that a term's hash gives is a folder, and
within it files are sorted by term, so row groups without it are passed over. Document lengths are
stored with postings, and their counts and sums by (workbook, kind, sheet, field), so no text is read
but that of the hits. Scores equal those of a scan of the same documents.

Vectors are known by model and hash of their text. Putting a workbook embeds texts that no version
holds yet, in order of length; a question embeds itself alone.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.layers import embeddable, embedding_text
from tabulon.operators.search import B, FIELDS, K1, analysed, nearest, normalised

BUCKETS = 64
MANIFEST = "version string, model string, workbook_hash string"


def text_column(docs: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- storing ---
    def _append(self, name: str, rows: DataFrame, version: str, *parts: str) -> None:
        rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", *parts).parquet(f"{self.root}/{name}")

    def put(self, workbook_hash: str, docs: DataFrame, embed=None, model: str | None = None, fields: dict[str, float] = FIELDS) -> None:
        """Store a workbook's documents (doc, kind, sheet, cells and any of the fields), their postings, and vectors if there is an embedder."""
        version, known = uuid4().hex, [f for f in fields if f in docs.columns]
        cells = F.coalesce(F.col("cells"), F.lit(0)).cast("double") if "cells" in docs.columns else F.lit(0.0)
        of = [F.lit(workbook_hash).alias("workbook_hash"), "doc", text_column(docs, "kind").alias("kind"), text_column(docs, "sheet").alias("sheet")]
        self._append("documents", docs.withColumns({"workbook_hash": F.lit(workbook_hash), "kind": text_column(docs, "kind"), "sheet": text_column(docs, "sheet")}), version)
        stored = self._version("documents", version)
        text = lambda f: F.concat_ws(" ", f) if docs.schema[f].dataType.typeName() == "array" else F.col(f)
        terms = stored.select(*of, (1 + F.log10(1 + cells) / 4).alias("weight"), *[analysed(text(f)).alias(f) for f in known])
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in known]))
        self._append("terms", terms.withColumn("f", each).select(*of, "weight", "f.field", "f.terms"), version)
        terms = self._version("terms", version)
        count = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf")))
        postings = terms.select(*of, "weight", "field", F.size("terms").alias("length"), F.explode(count).alias("t")).select(*of, "weight", "field", "length", "t.*").withColumn("bucket", bucket_of(F.col("term")))
        self._append("postings", postings.repartition("bucket").sortWithinPartitions("bucket", "term"), version, "bucket")
        self._append("lengths", terms.groupBy("workbook_hash", "kind", "sheet", "field").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("total")), version)
        if embed is not None:
            self._embed(workbook_hash, stored, version, embed, model)
        row = self.spark.createDataFrame([(version, model, workbook_hash)], MANIFEST)
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workbook_hash").parquet(f"{self.root}/manifest")

    def _embed(self, workbook_hash: str, docs: DataFrame, version: str, embed, model: str | None) -> None:
        texts = embeddable(docs).withColumn("text", embedding_text(docs))
        texts = texts.select("doc", "kind", "sheet", "text", F.sha2("text", 256).alias("text_hash"))
        held = self._all("vectors")
        if held is not None:
            # Of equal texts one vector is kept; texts that have one are not embedded again.
            held = held.filter(F.col("model") == model).groupBy("text_hash").agg(F.any_value("embedding").alias("embedding"))
        fresh = texts.select("text", "text_hash").dropDuplicates(["text_hash"])
        fresh = fresh if held is None else fresh.join(held, "text_hash", "left_anti")
        # Texts of one length go together, as a model pads a batch to its longest.
        fresh = fresh.withColumn("size", F.length("text")).repartitionByRange("size").sortWithinPartitions("size")
        fresh = fresh.select("text_hash", embed("text").alias("raw")).select("text_hash", normalised(F.col("raw")).cast("array<float>").alias("embedding"))
        vectors = fresh if held is None else fresh.unionByName(held)
        rows = texts.join(vectors, "text_hash").select(F.lit(workbook_hash).alias("workbook_hash"), "doc", "kind", "sheet", "text_hash", "embedding", F.lit(model).alias("model"))
        self._append("vectors", rows, version)

    def forget(self, workbook_hash: str) -> None:
        """No reader sees the workbook any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/workbook_hash={workbook_hash}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # --- reading ---
    def _all(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}") if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) else None

    def _version(self, name: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").filter(F.col("version") == version).drop("version")

    def entries(self) -> DataFrame:
        found = self._all("manifest")
        return self.spark.createDataFrame([], MANIFEST) if found is None else found

    def _read(self, name: str, kinds: list[str] | None = None, workbook: str | None = None, sheet: str | None = None) -> DataFrame:
        """Rows of the versions that count, of these kinds, this workbook and this sheet."""
        current = self.entries() if workbook is None else self.entries().filter(F.col("workbook_hash") == workbook)
        rows = self.spark.read.parquet(f"{self.root}/{name}").join(current.select("version"), "version", "left_semi")
        for test in ([F.col("kind").isin(kinds)] if kinds else []) + ([F.col("sheet") == sheet] if sheet else []):
            rows = rows.filter(test)
        return rows

    def documents(self, **where) -> DataFrame:
        return self._read("documents", **where).drop("version")

    def postings(self, terms: list[str], **where) -> DataFrame:
        """Postings of these terms; other buckets are not opened."""
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).collect()})
        return self._read("postings", **where).filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def scores(self, terms: list[str], fields: dict[str, float] = FIELDS, **where) -> DataFrame:
        """workbook_hash, doc, weight and s0, s1, .. of each document with a term: boosted BM25 scores summed over the fields."""
        found = self.postings(terms, **where).filter(F.col("field").isin(list(fields)))
        lengths = self._read("lengths", **where).groupBy("field").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
        # At most a row for each field and term: fields are few, and terms are those of the question.
        counts = found.groupBy("field", "term").agg(F.count("*").alias("df")).join(lengths, "field")
        boost = F.element_at(F.create_map(*[F.lit(x) for f, b in fields.items() for x in (f, b)]), F.col("field"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        met = found.join(F.broadcast(counts), ["field", "term"]).withColumn("part", part)
        each = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("part"))), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(terms)]
        return met.groupBy("workbook_hash", "doc").agg(F.first("weight").alias("weight"), *each)

    def nearest(self, question: str, embed, model: str | None, k: int, **where) -> DataFrame:
        """(doc, score): the stored vectors nearest the question's, which alone is embedded; those with no likeness are left out."""
        asked = self.spark.createDataFrame([(question,)], "text string").select(embed("text").alias("raw")).select(normalised(F.col("raw")).alias("v")).collect()[0]["v"]
        vectors = self._read("vectors", **where).filter(F.col("model") == model)
        return nearest(vectors.withColumn("key", F.struct("workbook_hash", "doc")), asked, k, "key").filter("score > 0").select("key.workbook_hash", "key.doc", "score")
