"""A stored collection of chunks that grows by imports: only what is new is written and embedded.

Chunks lie in ``buckets`` folders by the hash of their key. An import compares fingerprints of the incoming
rows with the stored ones, reads the buckets that hold something new, and writes these alone under a
new version; a manifest of one row a bucket (``sinks.save_state``) says which version of each bucket
counts. A stopped import leaves files that no manifest names. A chunk whose text is unchanged keeps
its vector; only rows without one are embedded, among them those whose batch failed before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions import text as X
from quizmill.functions.models import Embedder, embed_texts
from quizmill.operators import retrieve as RT
from quizmill.operators.evidence import backfill_tier
from quizmill.operators.shape import chunk_key
from quizmill.sources import chunks as K
from quizmill.sources import sinks
from quizmill.sources.jsonl import path_exists
from quizmill.storage import materialize

VECTOR = ["embedding", "embedding_model"]


@dataclass
class ChunkCollection:
    spark: SparkSession
    base: str
    embed: Embedder
    model: str
    dim: int
    buckets: int = 64
    default_tier: str = "tier_2"
    batch_size: int = 32

    def manifest(self) -> dict[int, int]:
        """Version of each bucket that has one; ``buckets`` rows at most."""
        table = sinks.load_state(self.spark, f"{self.base}/manifest")
        return {} if table is None else {r["bucket"]: r["version"] for r in table.collect()}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The stored chunks (of some buckets), or None before the first import."""
        now = self.manifest()
        paths = [f"{self.base}/chunks/version={v}/bucket={b}" for b, v in now.items() if buckets is None or b in buckets]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.base}/chunks").parquet(*paths).drop("version")

    def incoming(self, rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
        """One row of each key with its bucket and fingerprints of the whole row and of the text; with ``stored``
        those only that are new or changed, found by keys and fingerprints before any whole row is moved."""
        rows = rows.withColumn("chunk_id", F.coalesce(F.nullif(chunk_key(rows), F.lit("")), F.md5("content")))
        rows = backfill_tier(rows.where(F.col("chunk_id").isNotNull()), self.default_tier)
        own = [c for c in rows.columns if c != "chunk_id" and not c.startswith("_source")]
        marked = rows.withColumns({
            "fingerprint": F.sha2(F.to_json(F.struct(*own)), 256),
            "text_mark": F.md5(F.coalesce(X.first_text(F.col("content"), F.col("summary")), F.lit(""))),
        })
        if stored is not None:
            key = ["chunk_id", "fingerprint"]
            latest = marked.groupBy("chunk_id").agg(F.max("fingerprint").alias("fingerprint"))
            changed = materialize(latest.join(stored.select(key), key, "left_anti"), "changed-keys")
            marked = marked.join(changed, key, "left_semi")
        rest = [c for c in marked.columns if c not in ("chunk_id", "fingerprint")]
        one = marked.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "fingerprint").alias("r"), F.max("fingerprint").alias("fingerprint"))
        return one.select(
            "chunk_id", "fingerprint", "r.*", F.pmod(F.xxhash64("chunk_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        )

    def import_folder(self, directory: str, source_tier: str | None = None, pattern: str = "*.json") -> dict[str, int]:
        """Read the chunk files of a folder; how many chunks were new or changed, buckets written and
        vectors asked for."""
        return self.import_rows(K.read_chunk_json(self.spark, directory, source_tier=source_tier, pattern=pattern))

    def import_rows(self, rows: DataFrame) -> dict[str, int]:
        stored = self.read()
        new = self.incoming(rows, stored)
        touched: set[int] = set()
        if stored is not None:
            lacking = stored.where(self.lacks()).select("bucket").distinct()
            touched |= {r["bucket"] for r in lacking.collect()}  # ``buckets`` at most
        new = materialize(new, "changed")
        counts = {r["bucket"]: r["n"] for r in new.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched |= counts.keys()
        report = {"changed": sum(counts.values()), "buckets": len(touched), "embedded": 0}
        if not touched:
            return report
        old = self.read(sorted(touched)) if stored is not None else None
        whole = self.merged(new, old)
        todo = whole.where(self.lacks()).select("chunk_id", self.text().alias("text"))
        if old is not None:  # else it is read from the changed rows, which are written already
            todo = materialize(todo, "todo")
        report["embedded"] = todo.count()
        vectors = embed_texts(todo, "chunk_id", "text", self.embed, self.model, self.batch_size)
        vectors = RT.check_dimension(vectors.where(F.col("embedding").isNotNull()), self.dim)
        self.write(K.upsert_columns(whole, vectors, "chunk_id"), touched)
        return report

    def merged(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        """The touched buckets with the changed rows in place of the old ones."""
        empty = {"embedding": F.lit(None).cast("array<float>"), "embedding_model": F.lit(None).cast("string")}
        if old is None:
            return new.withColumns(empty)
        kept = old.select("chunk_id", "text_mark", *VECTOR)  # a row's vector belongs to its text
        fresh = new.join(kept, ["chunk_id", "text_mark"], "left").select(*new.columns, *VECTOR)
        return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh, allowMissingColumns=True)

    @staticmethod
    def text():
        return X.first_text(F.col("content"), F.col("summary"))

    def lacks(self):
        return F.col("embedding").isNull() & ~X.blank(self.text())

    def write(self, whole: DataFrame, touched: set[int]) -> None:
        now = self.manifest()
        version = max(now.values(), default=0) + 1
        while path_exists(self.spark, f"{self.base}/chunks/version={version}"):  # left by a stopped import
            version += 1
        whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.base}/chunks/version={version}")
        now |= dict.fromkeys(touched, version)
        sinks.save_state(self.spark.createDataFrame(sorted(now.items()), "bucket int, version long"), f"{self.base}/manifest")
