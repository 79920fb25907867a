"""A keyed table that takes changes without being rewritten.

Rows lie in buckets of their key. A batch of changes is one more folder, a segment, with a number; readers put the newest
change of each key over the rows, and compaction folds segments into those buckets that have many. A version is a
manifest: where each bucket lies, and up to which segment it holds all changes. Segments and versions count once they
were written to their end. Readers may come at any time; one writer at a time changes a table (a second that takes
the same number fails).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.operators.labels import latest_per_key, merge_by_key, one_per_key
from ledgerspark.sources.tables import complete_folders, delete_folder, folder_names

BUCKET, SEGMENT, DELETED = "__bucket", "segment", "__deleted"
#: Keys of pending changes are broadcast up to this size, counted before; beyond it both sides are dealt by key.
BROADCAST_BYTES = 32 << 20
_MANIFEST_SCHEMA = "bucket int, path string, through long"


@dataclass(frozen=True)
class KeyedStore:
    """The table in ``base``; ``schema`` are its columns, ``keys`` those that tell rows apart and are never null."""

    spark: SparkSession
    base: str
    schema: T.StructType
    keys: tuple[str, ...]

    def create(self, rows: DataFrame, buckets: int = 64) -> None:
        """The first version. Rows that share a key all stay until a change to it; buckets are fixed from here on.

        A bucket should be what one compaction may rewrite, so their number follows the table's size.
        """
        if folder_names(self.spark, self.base, "version="):
            raise ValueError(f"{self.base} has a table already")
        self._write_version(0, rows.select(*self.schema.fieldNames()), {b: (None, 0) for b in range(buckets)}, list(range(buckets)), 0)

    def change(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, order: str | None = None) -> int:
        """Add a batch of changes as a segment and return its number; rows and earlier segments aren't read.

        Of several upserts of a key the last by ``order`` counts (without it the greatest by its columns), and an
        upsert counts before a deletion in the same batch. Deleting what isn't there does nothing. Null keys are errors.
        """
        columns = self.schema.fieldNames()
        parts = []
        if upserts is not None:
            chosen = upserts.select(*columns)
            chosen = latest_per_key(chosen, list(self.keys), order) if order else one_per_key(chosen, list(self.keys))
            parts.append(chosen.withColumn(DELETED, F.lit(False)))
        if deletes is not None:
            gone = deletes.select(*self.keys).distinct()
            if upserts is not None:
                gone = gone.join(parts[0].select(*self.keys), list(self.keys), "left_anti")
            parts.append(gone.withColumn(DELETED, F.lit(True)))
        if not parts:
            raise ValueError("nothing to change")
        batch = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        for field in self.schema.fields:
            if field.name not in batch.columns:
                batch = batch.withColumn(field.name, F.lit(None).cast(field.dataType))
        number = max([n for n, _ in self._numbered("segment=", complete=False)] + [self._through()[1]]) + 1
        self._bucketed(batch.select(*columns, DELETED), len(self._manifest())).write.parquet(f"{self.base}/segment={number}")
        return number

    def read(self) -> DataFrame:
        """The table as of the last segment that was written to its end.

        Only changes that no bucket holds yet are reduced by key. Their keys' size is counted when this is called: up to
        ``BROADCAST_BYTES`` the join to them is a broadcast and the rows don't move.
        """
        return self._resolved(self._manifest(), self._segments())

    def pending(self) -> DataFrame:
        """bucket and the changes it doesn't hold yet, newest ones and others."""
        return self._changes(self._manifest(), self._segments()).groupBy(F.col(BUCKET).alias("bucket")).agg(F.count("*").alias("changes"))

    def compact(self, min_changes: int = 1) -> list[int]:
        """Fold changes into the buckets that have at least so many, as a new version, and return these buckets.

        The other buckets stay where they are, their changes in the segments. Nothing that an earlier version names is touched.
        """
        manifest, segments = self._manifest(), self._segments()
        counts = self._changes(manifest, segments).groupBy(BUCKET).count().collect()  # at most one row per bucket
        due = sorted(row[BUCKET] for row in counts if row["count"] >= min_changes)
        if due:
            version = max(n for n, _ in self._numbered("version=", complete=False)) + 1
            rows = self._resolved({b: manifest[b] for b in due}, segments)
            self._write_version(version, rows, manifest, due, max(n for n, _ in segments))
        return due

    def clean(self) -> None:
        """Delete what the newest version doesn't need: segments that all its buckets hold, and folders of rows it doesn't name.

        Readers of earlier versions must have ended.
        """
        manifest = self._manifest()
        newest = max(n for n, _ in self._numbered("version=", complete=True))
        named = {path for path, _ in manifest.values() if path}
        lowest = min(through for _, through in manifest.values())
        for number, name in self._numbered("segment=", complete=False):
            if number <= lowest:
                delete_folder(self.spark, f"{self.base}/{name}")
        for number, name in self._numbered("version=", complete=False):
            if number < newest:
                for bucket in folder_names(self.spark, f"{self.base}/{name}/rows", f"{BUCKET}="):
                    if f"{name}/rows/{bucket}" not in named:
                        delete_folder(self.spark, f"{self.base}/{name}/rows/{bucket}")
                delete_folder(self.spark, f"{self.base}/{name}/manifest")

    def _numbered(self, prefix: str, complete: bool) -> list[tuple[int, str]]:
        if not complete:
            names = folder_names(self.spark, self.base, prefix)
        else:
            names = complete_folders(self.spark, self.base, prefix, "manifest/_SUCCESS" if prefix == "version=" else "_SUCCESS")
        return sorted((int(name.removeprefix(prefix)), name) for name in names)

    def _segments(self) -> list[tuple[int, str]]:
        """The complete segments that some bucket doesn't hold yet."""
        lowest = self._through()[0]
        return [(n, name) for n, name in self._numbered("segment=", complete=True) if n > lowest]

    def _through(self) -> tuple[int, int]:
        through = [t for _, t in self._manifest().values()]
        return min(through), max(through)

    def _manifest(self) -> dict[int, tuple[str | None, int]]:
        """Path and last folded segment of each bucket, by the newest complete version."""
        versions = self._numbered("version=", complete=True)
        if not versions:
            raise ValueError(f"{self.base} holds no table")
        rows = self.spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{self.base}/{versions[-1][1]}/manifest").collect()
        return {row["bucket"]: (row["path"], row["through"]) for row in rows}

    def _bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        missing = F.greatest(*[F.col(k).isNull() for k in self.keys]) if len(self.keys) > 1 else F.col(self.keys[0]).isNull()
        place = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        return df.withColumn(BUCKET, F.when(missing, F.raise_error(F.lit("a row has no key")).cast("int")).otherwise(place))

    def _write_version(self, version: int, rows: DataFrame, manifest: dict, due: list[int], through: int) -> None:
        """Rows of the buckets that are due, then the manifest, whose end makes the version count."""
        folder = f"version={version}"
        placed = self._bucketed(rows, len(manifest))
        placed.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *self.keys).write.partitionBy(BUCKET).parquet(f"{self.base}/{folder}/rows")
        written = set(folder_names(self.spark, f"{self.base}/{folder}/rows", f"{BUCKET}="))
        changed = {b: (f"{folder}/rows/{BUCKET}={b}" if f"{BUCKET}={b}" in written else None, through) for b in due}
        entries = [(b, *place) for b, place in sorted({**manifest, **changed}.items())]
        self.spark.createDataFrame(entries, _MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{self.base}/{folder}/manifest")

    def _changes(self, manifest: dict, segments: list[tuple[int, str]]) -> DataFrame:
        """The changes that the buckets of ``manifest`` don't hold yet, with bucket and segment."""
        more = T.StructType([*self.schema.fields, T.StructField(DELETED, T.BooleanType()), T.StructField(BUCKET, T.IntegerType()), T.StructField(SEGMENT, T.LongType())])
        if not segments:
            return self.spark.createDataFrame([], more)
        found = self.spark.read.schema(more).option("basePath", self.base).parquet(*[f"{self.base}/{name}" for _, name in segments])
        held = self.spark.createDataFrame([(b, t) for b, (_, t) in manifest.items()], "held int, through long")
        # One row per bucket of the manifest.
        return found.join(F.broadcast(held), (F.col(BUCKET) == F.col("held")) & (F.col(SEGMENT) > F.col("through"))).drop("held", "through")

    def _resolved(self, manifest: dict, segments: list[tuple[int, str]]) -> DataFrame:
        columns = self.schema.fieldNames()
        paths = [f"{self.base}/{path}" for path, _ in manifest.values() if path]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        if not segments:
            return rows
        changes = self._changes(manifest, segments)
        newest = latest_per_key(changes, list(self.keys), SEGMENT)
        width = sum((F.octet_length(F.col(k).cast("string")) for k in self.keys), F.lit(16))
        size = changes.agg(F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()["size"]
        gone = newest.select(*self.keys)
        return merge_by_key(rows, list(self.keys), deletes=F.broadcast(gone) if size <= BROADCAST_BYTES else gone).unionByName(newest.filter(~F.col(DELETED)).select(*columns))
