"""Shared working folder for staged tables."""

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of files whose rows are shuffled at once by work done in parts.
PART_BYTES = 256 * 2**20
#: Folders of rows that are laid out by a hash.
BUCKETS = 16
APART = "tallyloom_part"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may go without the setting; it then gets a new folder under /tmp.
    """
    configured, local = spark.conf.get(CONF, None), spark.sparkContext.master.startswith("local")
    if configured:
        if not local and re.match(r"(file:/*)?/(tmp|var/tmp)(/|$)", configured):
            raise ValueError(f"{CONF} names {configured}, a temporary folder of one machine")
        return configured.rstrip("/")
    if not local:
        raise ValueError(f"set {CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set(CONF, folder)
    return folder


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it does not exist."""
    place, files = _path(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(place)] if files.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    place, files = _path(spark, path)
    files.delete(place, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder."""
    place, files = _path(spark, path)
    return files.getContentSummary(place).getLength()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """The folders staged while it is open: ``with Scratch(spark): ...`` deletes them at its end.

    Leave it only when what was made of the staged frames is written or collected: until then lost executors
    read the files again, afterwards nobody needs them. ``keep`` lets it end without deleting; ``delete`` follows later.
    """

    _open: ContextVar[tuple["Scratch", ...]] = ContextVar("open", default=())

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.kept = False

    def __enter__(self) -> "Scratch":
        self._token = self._open.set((*self._open.get(), self))
        return self

    def __exit__(self, kind, *_) -> None:
        self._open.reset(self._token)
        if kind is not None or not self.kept:
            self.delete()

    def keep(self) -> None:
        self.kept = True

    def spare(self) -> None:
        """The folder staged last goes with the scope around this one instead."""
        outer = self._open.get()[:-1]
        path = self.paths.pop()
        if outer:
            outer[-1].paths.append(path)

    def delete(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())

    @classmethod
    def note(cls, path: str) -> None:
        if cls._open.get():
            cls._open.get()[-1].paths.append(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For frames that feed several jobs: the plan above runs once, readers get column
    pruning and real sizes, and a lost executor re-reads files instead of recomputing. The folder goes with
    the innermost open ``Scratch``; without one it stays.
    """
    path = new_path(df.sparkSession, name)
    Scratch.note(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Every write and collect inside leaves no shuffle files when it ends; else they stay until Java frees its plan."""
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


class Apart:
    """Rows written, without a shuffle, to a folder for each value of ``by``, to be worked on in groups of folders.

    Work that needs rows of one value only then shuffles the rows of a group at a time. The folders go with
    the innermost open ``Scratch``, or when their group is done.
    """

    def __init__(self, df: DataFrame, by: Column, name: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = new_path(self.spark, name)
        Scratch.note(self.path)
        df.withColumn(APART, by).write.option("compression", "zstd").partitionBy(APART).parquet(self.path)
        folders = [folder for folder in children(self.spark, self.path) if folder.startswith(f"{APART}=")]
        self.sizes = {folder.removeprefix(f"{APART}="): size_of(self.spark, f"{self.path}/{folder}") for folder in sorted(folders)}

    def read(self, values: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{APART}={value}" for value in values])

    def done(self, values: Iterable[str]) -> None:
        for value in values:
            delete(self.spark, f"{self.path}/{APART}={value}")


def grouped(sizes: dict[str, int]) -> list[list[str]]:
    """The names in order, in groups of ``PART_BYTES`` at most; a larger one is a group of its own."""
    out, held = [], 0
    for name, size in sizes.items():
        if not out or held + size > PART_BYTES:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


def stage_in_parts(df: DataFrame, by: Column, work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``stage(work(df), name)`` for work that rows of different values of ``by`` do not share."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    Scratch.note(path)
    with Scratch(spark), shuffles_freed(spark):
        apart = Apart(df, by, f"{name}-parts")
        for group in grouped(apart.sizes):
            work(apart.read(group)).write.mode("append").parquet(path)
            apart.done(group)
        if not apart.sizes:
            work(spark.createDataFrame([], df.schema)).write.parquet(path)
    return spark.read.schema(work(df).schema).parquet(path)
