"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    context = spark.sparkContext
    if getattr(context, "_inkmill_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, Path(root.name) / path.relative_to(root))
    file = Path(tempfile.mkdtemp(prefix="inkmill-")) / "inkmill_package.zip"
    file.write_bytes(data.getvalue())
    context.addPyFile(str(file))  # the driver serves it; executors never read the temporary folder
    context._inkmill_shipped = True


def table(spark: SparkSession, directory: str, name: str, spread: bool = False) -> DataFrame:
    """One table; with ``spread``, an input too small to occupy every core is dealt out to all of them."""
    ship(spark)
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    if spread:
        cores = spark.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < cores * (4 << 20):
            df = df.repartition(cores)
    return df


class Shared:
    """A value shipped to the executors once, and what is built from it once per Python worker (the last few are kept)."""

    def __init__(self, spark: SparkSession, value: object, build: Callable) -> None:
        self.name, self.build, self.value = uuid.uuid4().hex, build, spark.sparkContext.broadcast(value)

    def get(self) -> object:
        if self.name not in _built:
            while len(_built) >= 8:
                _built.pop(next(iter(_built)))
            _built[self.name] = self.build(self.value.value)
        return _built[self.name]


_built: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the folder set on the context.

    Where neither is set a folder of this machine serves a local master; on a cluster that is an error, because its
    executors could not read each other's files there.
    """
    context = spark.sparkContext
    on_context = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (on_context.get() if on_context.isDefined() else None)
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), "inkmill-shared")
    if not on_context.isDefined():
        context.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back, so lineage is cut and executors may be lost.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """One row per key: the payload of the latest delivery, ties broken by the payload itself (nulls lowest).

    For small payloads: they are moved in the shuffle.  Texts go through ``latest_texts``.
    """
    top = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in payload])).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in payload])


#: Repeated keys up to this number are broadcast; beyond it they are met by a join.
MOST_REPEATED = 1_000_000


def latest_texts(df: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """``latest`` for large payloads: they stay where they are, only keys and times are shuffled.

    A first pass over keys and times finds the keys delivered more than once and their latest time; all other rows are
    dropped in place.  Only where several rows of a key share the latest time are these grouped with their payloads.
    """
    times = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_c"))
    top = times.groupBy(*keys).agg(F.max(F.struct(order, "_c")).alias("_t"), F.sum("_c").alias("_n")).where("_n > 1")
    marks = materialise(top.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"_t.{order}").alias("_best"), (F.col("_t._c") > 1).alias("_tied")))
    seen = marks.agg(F.count(F.lit(1)).alias("n"), F.max("_tied").alias("tied")).first()
    if not seen["n"]:
        return df.select(*keys, *payload)
    if seen["n"] <= MOST_REPEATED:
        marks = F.broadcast(marks)
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    met = df.select(*dict.fromkeys([*keys, order, *payload])).join(marks, same, "left").where(F.col("_tied").isNull() | F.col(order).eqNullSafe(F.col("_best")))
    if not seen["tied"]:
        return met.select(*keys, *payload)
    return met.where(~F.coalesce("_tied", F.lit(False))).select(*keys, *payload).unionByName(latest(met.where("_tied"), keys, order, payload))


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, each computed once: the generator keeps later steps from copying the expressions."""
    packed = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return df.select(*keep, F.explode(packed).alias("_s")).select(*keep, *[F.col(f"_s.{k}").alias(k) for k in columns])
