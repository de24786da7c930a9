"""Tables that change together: immutable data folders and versions that name them.

A version is a Parquet table of (name, scope, folder, run, digest, rows), one row for each table and scope (a repository, or whatever
is loaded as a whole), in a folder of its own; what makes it current is a small file of its number that is created only if there is
none. Readers take the highest number. So all tables of a load appear at once, a writer that is lost before the end leaves the version
before as it was, and of two writers that began from one version the second fails and may try again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "name string, scope string, folder string, run long, digest string, rows long"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session without one has a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/lodestone-store"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


class Store:
    """Tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest committed number, 0 if there is none."""
        path, fs = self._path("committed")
        return max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=0) if fs.exists(path) else 0

    def live(self, version: int | None = None) -> DataFrame:
        """What a version (the current one if none is named) consists of."""
        n = self.version() if version is None else version
        return self.spark.read.schema(VERSION).parquet(f"{self.root}/versions/{self._name(n)}") if n else self.spark.createDataFrame([], VERSION)

    def _name(self, n: int) -> str:
        path, fs = self._path(f"committed/{n}")
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version: rows of each scope from the folder that the version names; None if it has none."""
        live = self.live(version).filter(F.col("name") == name)
        folders = [r.folder for r in live.select("folder").distinct().collect()]
        if not folders:
            return None
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/data/{f}" for f in folders])
        return rows.join(live.select(F.col("scope").alias("_scope"), F.col("folder").alias("_folder")), ["_scope", "_folder"], "left_semi").drop("_scope", "_folder")

    def write(self, rows: DataFrame, scope: str) -> str:
        """Rows in a new data folder, which no version names yet; the folder's name."""
        folder = uuid.uuid4().hex
        rows.withColumns({"_scope": F.col(scope), "_folder": F.lit(folder)}).write.parquet(f"{self.root}/data/{folder}")
        return folder

    def append(self, name: str, rows: DataFrame, scope: str, run: int) -> int:
        """Add rows to a table beside what it has, in one commit; their number."""
        base = self.version()
        folder = self.write(rows, scope)
        own = self.spark.read.parquet(f"{self.root}/data/{folder}").groupBy(F.col("_scope").cast("string").alias("scope")).agg(F.count("*").alias("rows"))
        lines = own.select(F.lit(name).alias("name"), "scope", F.lit(folder).alias("folder"), F.lit(run).cast("long").alias("run"), F.lit(None).cast("string").alias("digest"), "rows")
        self.commit(self.live(base).union(lines), base)
        return own.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def commit(self, live: DataFrame, base: int) -> int:
        """Make `live` the version after `base`; fails if there is one already."""
        name = uuid.uuid4().hex
        live.select(*[c.split()[0] for c in VERSION.split(", ")]).write.parquet(f"{self.root}/versions/{name}")
        draft, fs = self._path(f"drafts/{name}")
        stream = fs.create(draft, False)
        try:
            stream.write(name.encode())
        finally:
            stream.close()
        target, _ = self._path(f"committed/{base + 1}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(draft, target):  # a name is whole when it appears
            raise FileExistsError(f"version {base + 1} was committed by another writer")
        return base + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete the data folders that none of the last `keep` versions names; their number. Not while a writer is at work."""
        last = self.version()
        named = {r.folder for n in range(max(1, last - keep + 1), last + 1) for r in self.live(n).select("folder").distinct().collect()}
        path, fs = self._path("data")
        gone = [s.getPath() for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def cut(df: DataFrame) -> DataFrame:
    """df, written to a scratch folder and read back: what comes after doesn't compute it again, nor after the loss of an executor."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
