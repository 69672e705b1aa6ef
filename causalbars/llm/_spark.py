"""Shared Spark plumbing: checkpoint tables, shipping code to workers, Arrow maps, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that Python sees at once; keeps the Python copy of the texts small.
SLICE_ROWS = 512
_MAX_BATCH_BYTES = 48 << 20
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in a local session that leaves it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = Path(tempfile.mkdtemp(prefix="causalbars-checkpoint-")).as_uri()
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cuts lineage: writes ``df`` once as Parquet in the shared folder and reads it back.

    Unlike a cache, the written table outlives lost executors. Shuffles of the write are removed as soon as it has
    ended (the session's own setting of that stands again afterwards).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/causalbars-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._causalbars_path = path
    return table


def drop_materialized(df: DataFrame) -> None:
    """Deletes the files of a table from :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_causalbars_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, whatever the driver's import path is."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= _MAX_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_MAX_BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="causalbars-"), "causalbars_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(Path(package.name) / file.relative_to(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def fields(ddl: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(ddl).fields)


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    out_ddl: str,
    compute: Callable[[list[str]], Sequence[pa.Array]],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One narrow Arrow pass over whole texts (null: empty): ``keep`` columns plus what ``compute`` returns."""
    ship_package(df.sparkSession)
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, *fields(out_ddl)])
    n, names = len(kept), schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                texts = [t or "" for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *compute(texts)], names=names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def replace_texts(df: DataFrame, text_col: str, size_col: str | None, rewrite: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """Rewrites one text column in a narrow Arrow pass, keeping all columns and their order.

    ``rewrite`` returns None for a text that stays as it is (nulls then stay null); ``size_col``, where it
    exists, follows the new length.
    """
    ship_package(df.sparkSession)
    names = df.columns
    text_at = names.index(text_col)
    size_at = names.index(size_col) if size_col in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                old = part.column(text_at).to_pylist()
                new = rewrite([t or "" for t in old])
                columns = list(part.columns)
                if any(x is not None for x in new):
                    columns[text_at] = pa.array([o if x is None else x for o, x in zip(old, new)], columns[text_at].type)
                    if size_at is not None:
                        sizes = columns[size_at].to_pylist()
                        columns[size_at] = pa.array([s if x is None else len(x) for s, x in zip(sizes, new)], columns[size_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.expr("xxhash64(u, v) % 1000003"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``(node, component)``; component: its least node.

    Alternating large-star and small-star contraction (Kiveris et al., 2014). Neighbour lists are never
    collected: each star is a map-side-combined minimum and an equi-join that adaptive execution may split,
    and every round is cut by a table in the shared folder.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = materialize(stars, "stars")
    seen = _fingerprint(stars)
    while seen[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(low.select("u", "m")).distinct(), "stars")
        now = _fingerprint(after)
        drop_materialized(stars)
        stars = after
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
