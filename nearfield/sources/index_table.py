"""Document tables keyed by id: create, drop, upsert, append, read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.blocks import counted
from nearfield.operators.corpus import dense_id
from nearfield.operators.schema import validate_vectors
from nearfield.session import cut_lineage, qualified, remove_folder, rename_folder, shared_dir

BUCKET = "_bucket"
COMMIT = "_commit"  # 0 for settled documents, else the upsert that wrote the version
LISTED_IDS = 1_000_000  # ids of unsettled versions sent to every task at most
COMMITS = 8  # unsettled upserts a bucket holds before they are merged
SHARE = 0.25  # of a bucket's documents: more unsettled versions than that are merged into them

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("_text_", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

# Vector dimensions of the stored index layouts.
SPECS = {
    "vector": {"dims": 768, "metric": "cosine"},
    "lsh": {"dims": 768, "metric": "cosine", "tables": 99, "bits": 1},
    "knn": {"dims": 768, "metric": "cosine", "shards": 2},
}


def index_name(spec: str, max_docs: int) -> str:
    return f"{spec}_{max_docs}"


def latest_per_id(rows: DataFrame, seq: str | None) -> DataFrame:
    """The last version of every id. The rank filter becomes a group limit before
    the shuffle, so many copies of one id never meet in one task."""
    order = F.monotonically_increasing_id().desc() if seq is None else F.col(seq).desc()
    place = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


class Index:
    """A Parquet table of whole documents, stored in buckets by a hash of the id.

    An upsert is one commit that only adds files: its documents, as newer
    versions, beside those that are there. A scan takes the newest version of
    every id; versions not yet settled are few, and their ids hide older
    documents where they lie. A bucket with many unsettled upserts has them
    merged into one, and into its documents once they are a good part of them,
    so that a document is rewritten a bounded number of times. A write that fails
    leaves the table as it was. One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.name = spark, name
        self.root = f"{(root or shared_dir(spark)).rstrip('/')}/index/{name}"
        self.buckets: int | None = None

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(
        self, spec: str = "vector", schema: T.StructType = DOCUMENT, dims: int | None = None, buckets: int = 16
    ) -> Index:
        """Size ``buckets`` so that one holds a few files of the expected table."""
        if spec not in SPECS:
            raise ValueError(f"unknown index layout: {spec}")
        if self.exists():
            raise ValueError(f"index {self.name} exists already")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        place = f"{self.root}/{uuid.uuid4().hex}"
        facts = {**SPECS[spec], "layout": spec, "buckets": buckets, "place": place, **({} if dims is None else {"dims": dims})}
        properties = ", ".join(f"'{k}'='{v}'" for k, v in facts.items())
        self.spark.sql(
            f"CREATE TABLE {self.name} ({columns}, {BUCKET} INT, {COMMIT} INT) USING parquet PARTITIONED BY ({BUCKET}, {COMMIT}) "
            f"LOCATION '{place}' TBLPROPERTIES ({properties})"
        )
        return self

    def drop(self) -> None:
        """Delete the index and its files; a missing one is fine."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_folder(self.spark, self.root)

    def properties(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}

    def _commits(self) -> list[tuple[int, int]]:
        """(bucket, commit) of everything stored; at most COMMITS and one per bucket."""
        return [(r[0], r[1]) for r in self.spark.table(self.name).select(BUCKET, COMMIT).distinct().collect()]

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest version of every id of a part of the table."""
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.col(COMMIT).desc()))
        open_rows = rows.where(F.col(COMMIT) > 0)
        fresh = open_rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
        ids = open_rows.select("id")
        hidden = F.broadcast(ids.distinct()) if counted(ids, LISTED_IDS) is not None else ids
        return rows.where(F.col(COMMIT) == 0).join(hidden, "id", "left_anti").select(*rows.columns).unionByName(fresh)

    def scan(self) -> DataFrame:
        rows = self.spark.table(self.name)
        settled = rows.where(F.col(COMMIT) > 0).isEmpty()
        return (rows if settled else self._newest(rows)).drop(BUCKET, COMMIT)

    def get(self, *ids) -> DataFrame:
        """Documents by id; only the buckets of those ids are read."""
        rows = self.spark.table(self.name)
        wanted = self.spark.createDataFrame([(int(i),) for i in ids], "id long").select(self._bucket()).distinct().collect()
        return self._newest(rows.where(F.col(BUCKET).isin([r[0] for r in wanted]) & F.col("id").isin(*ids))).drop(BUCKET, COMMIT)

    def _bucket(self):
        if self.buckets is None:
            self.buckets = int(self.properties()["buckets"])
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _write(self, rows: DataFrame, commit: int) -> None:
        """Add rows under a commit. A bucket is spread over several tasks and files."""
        ready = rows.select("*", self._bucket(), F.lit(commit).cast("int").alias(COMMIT))
        ready = ready.repartition(F.col(BUCKET), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)))
        ready.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def upsert(self, docs: DataFrame, seq: str | None = None, check_dims: int | None = None) -> DataFrame | None:
        """Replace or add whole documents by id; of several versions the last (by ``seq``) counts.

        A document without id fails the write. With ``check_dims`` documents
        whose vector is not valid are not stored but returned, each with its
        ``reason``. Files are written in proportion to ``docs`` only.
        """
        rejected = None
        if check_dims is not None:
            docs, rejected = validate_vectors(docs, check_dims)
        missing = F.raise_error("a document needs an id")
        checked = docs.withColumn("id", F.when(F.col("id").isNull(), missing).otherwise(F.col("id")).cast("long"))
        fields = [f for f in self.spark.table(self.name).schema.fields if f.name not in (BUCKET, COMMIT)]
        fresh = latest_per_id(checked, seq).select(*[F.col(f.name).cast(f.dataType) for f in fields])
        there = self._commits()
        self._reserve(max(self._last_id(), checked.agg(F.max("id")).first()[0] or 0))
        self._write(fresh, 1 + max(c for _, c in there) if there else 0)
        self._settle()
        return rejected

    def _settle(self) -> None:
        """Merge the unsettled upserts of buckets that have many.

        The merged rows are written before what they stand for is removed, and
        are the newest versions wherever both are seen.
        """
        by_bucket: dict[int, list[int]] = {}
        for bucket, commit in self._commits():
            if commit:
                by_bucket.setdefault(bucket, []).append(commit)
        full = {b: c for b, c in by_bucket.items() if len(c) > COMMITS}
        if not full:
            return
        rows = self.spark.table(self.name).where(F.col(BUCKET).isin(list(full)))
        sizes = rows.groupBy(BUCKET).agg(F.count_if(F.col(COMMIT) > 0).alias("open"), F.count_if(F.col(COMMIT) == 0).alias("settled"))
        grown = [r[BUCKET] for r in sizes.collect() if r["open"] >= SHARE * r["settled"]]
        merged = cut_lineage(self._newest(rows.where(F.col(BUCKET).isin(grown) | (F.col(COMMIT) > 0))).drop(BUCKET, COMMIT))
        number = 1 + max(c for commits in full.values() for c in commits)
        self._write(merged, number)
        place = self.properties()["place"]
        for bucket, commits in full.items():
            folder = f"{place}/{BUCKET}={bucket}/{COMMIT}="
            for commit in [*commits, *([0] if bucket in grown else [])]:
                remove_folder(self.spark, f"{folder}{commit}")
            if bucket in grown:
                rename_folder(self.spark, f"{folder}{number}", f"{folder}0")
        self.spark.catalog.refreshTable(self.name)

    def _reserve(self, last: int) -> None:
        """Note the largest id before it is written: a write that fails leaves a gap, never an id used twice."""
        self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('last_id'='{last}')")

    def _last_id(self) -> int:
        """The largest id given so far, from the table's properties; a table without the note is looked through once."""
        noted = self.properties().get("last_id")
        return int(noted) if noted is not None else (self.spark.table(self.name).agg(F.max("id")).first()[0] or 0)

    def append(self, rows: DataFrame, order: str) -> None:
        """Add rows without ids; numbering goes on from the largest id. Nothing stored is rewritten or read."""
        fields = [f for f in self.spark.table(self.name).schema.fields if f.name not in (BUCKET, COMMIT)]
        last = self._last_id()
        numbered = dense_id(rows.drop("id").withColumn("_order", F.col(order)), "_order", out="id", start=last + 1)
        known = [
            F.col(f.name).cast(f.dataType) if f.name in numbered.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in fields
        ]
        self._reserve(last + numbered.count())
        self._write(numbered.select(*known), 0)


def append_batch(spark: SparkSession, path: str, rows: DataFrame, order: str, batch_id: int) -> None:
    """Append one numbered batch to a table of batches at ``path``; running the same batch again replaces it.

    Each batch is its own directory, and its ids start after the batches before it,
    whose rows a small table beside it (``_counts``) has, one row a batch.
    """
    path = qualified(spark, path)
    counts = f"{path}_counts"
    earlier = _batches_before(spark, counts, batch_id)
    last = 0 if earlier is None else (earlier.agg(F.sum("n")).first()[0] or 0)
    numbered = dense_id(rows, order, out="id", start=last + 1)
    numbered.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    numbered.agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")


def _batches_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    from nearfield.sources.vector_files import filesystem

    import pyarrow.fs as pafs

    fs, root = filesystem(path)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return None
    names = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory]
    before = [n for n in names if "batch=" in n and int(n.rsplit("batch=", 1)[1]) < batch_id]
    if not before:
        return None
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    return spark.read.parquet(*[prefix + n for n in before])
