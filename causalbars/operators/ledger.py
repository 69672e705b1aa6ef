"""Append-only tables: idempotent merges, revision conflicts, hash-chained segments, holdout outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .splits import CHUNK, ordinals

GENESIS = "0" * 64


def same_number(a: Column, b: Column, rtol: float = 1e-12, atol: float = 1e-9) -> Column:
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))


def classify(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """``incoming`` with change = new, same or conflict against what is stored under the key."""
    known = stored.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in numbers], F.lit(True).alias("_known"))
    equal = F.lit(True)
    for c in numbers:
        equal = equal & same_number(F.col(c), F.col(f"_s_{c}"))
    joined = incoming.join(known, list(keys), "left")
    return joined.withColumn("change", F.when(F.col("_known").isNull(), "new").when(equal, "same").otherwise("conflict")).drop("_known", *[f"_s_{c}" for c in numbers])


def unseen(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: rows whose key is not stored."""
    return incoming.join(stored.select(*keys), list(keys), "left_anti")


def revisions(ledger: DataFrame, source: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Overlapping rows that were revised, by key and column."""
    joined = ledger.join(source.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in numbers]), list(keys))
    found = F.explode(F.array_compact(F.array(*[F.when(~same_number(F.col(c), F.col(f"_n_{c}"), 1e-12, 1e-10), F.lit(c)) for c in numbers])))
    return joined.select(*keys, found.alias("column"))


def row_text(columns: Sequence[str]) -> Column:
    """The canonical text of a row: column=value in column order, separators escaped; a column without ``=`` is NULL,
    and floating-point values are the shortest texts that read back as the same number (17 digits at most)."""
    parts = []
    for c in sorted(columns):
        escaped = F.regexp_replace(F.col(c).cast("string"), r"([\\|=])", r"\\$1")
        parts.append(F.when(F.col(c).isNull(), F.lit(c)).otherwise(F.concat(F.lit(f"{c}="), escaped)))
    return F.concat_ws("|", *parts)


def chain(rows: DataFrame, columns: Sequence[str], key: str = "segment", heads: DataFrame | None = None) -> DataFrame:
    """Hash-chains rows by t inside each segment: row_hash = sha256(previous hash, row).

    A chain is serial, so a segment is one group, hashed in one pass over its sorted rows; segments are chained in
    parallel. Segments are the caller's choice and should be of bounded size, such as a series and hour. ``heads``
    (segment, head) continues stored segments.
    """
    texts = rows.withColumn("_text", row_text(columns))
    texts = texts.join(heads, key, "left") if heads is not None else texts.withColumn("head", F.lit(None).cast("string"))
    texts = texts.withColumn("_head", F.coalesce("head", F.lit(GENESIS))).select(*rows.columns, "_text", "_head")
    names = [*rows.columns, "previous_row_hash", "row_hash"]
    schema = T.StructType([*rows.schema.fields, T.StructField("previous_row_hash", T.StringType()), T.StructField("row_hash", T.StringType())])
    width = len(rows.columns)

    def fold(table):
        import hashlib

        import pyarrow as pa

        table = table.sort_by([("t", "ascending"), ("_text", "ascending")])
        links = [table.column("_head")[0].as_py()]
        for text in table.column("_text").to_pylist():
            links.append(hashlib.sha256(f"{links[-1]}|{text}".encode()).hexdigest())
        return pa.table([*table.columns[:width], pa.array(links[:-1], pa.string()), pa.array(links[1:], pa.string())], names=names)

    return texts.groupBy(key).applyInArrow(fold, schema)


def verify(ledger: DataFrame, columns: Sequence[str], key: str = "segment") -> DataFrame:
    """Rows of a chained ledger that break it: a changed row, a broken link or a time that does not increase."""
    w = Window.partitionBy(key).orderBy("t", "row_hash")
    before, earlier = F.lag("row_hash").over(w), F.lag("t").over(w)
    fault = F.when(F.sha2(F.concat("previous_row_hash", F.lit("|"), row_text(columns)), 256) != F.col("row_hash"), "CHANGED_ROW").when(F.col("previous_row_hash") != F.coalesce(before, F.lit(GENESIS)), "BROKEN_LINK").when(earlier >= F.col("t"), "TIME_NOT_INCREASING")
    return ledger.withColumn("fault", fault).where("fault IS NOT NULL")


class BackdatedRows(ValueError):
    """Rows to append are not later than what a segment holds."""


_HEADS = "block long, rows long, first_t long, last_t long, digest string, head string"


def _digests(rows: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, block, rows, first_t, last_t, digest) of rows with a block number; a block is hashed in one group."""
    texts = rows.select(key, "block", "t", row_text(columns).alias("_text"))

    def fold(table):
        import hashlib

        import pyarrow as pa

        table = table.sort_by([("t", "ascending"), ("_text", "ascending")])
        link = GENESIS
        for text in table.column("_text").to_pylist():
            link = hashlib.sha256(f"{link}|{text}".encode()).hexdigest()
        t = table.column("t")
        return pa.table([table.column(key).slice(0, 1), table.column("block").slice(0, 1), pa.array([table.num_rows], pa.int64()), t.slice(0, 1), t.slice(table.num_rows - 1), pa.array([link])], names=[key, "block", "rows", "first_t", "last_t", "digest"])

    kind = rows.schema[key].dataType.simpleString()
    return texts.groupBy(key, "block").applyInArrow(fold, f"`{key}` {kind}, block long, rows long, first_t long, last_t long, digest string")


def _with_heads(digests: DataFrame, key: str, heads: DataFrame | None) -> DataFrame:
    """Chains the blocks of each segment: head = sha256(previous head, digest); one row a block."""
    last = heads.groupBy(key).agg(F.max_by("head", "block").alias("_head")) if heads is not None else None
    joined = digests.join(last, key, "left") if heads is not None else digests.withColumn("_head", F.lit(None).cast("string"))
    names = [key, "block", "rows", "first_t", "last_t", "digest", "head"]

    def fold(table):
        import hashlib

        import pyarrow as pa

        table = table.sort_by("block")
        link, made = table.column("_head")[0].as_py() or GENESIS, []
        for digest in table.column("digest").to_pylist():
            link = hashlib.sha256(f"{link}|{digest}".encode()).hexdigest()
            made.append(link)
        return pa.table([*(table.column(c) for c in names[:-1]), pa.array(made, pa.string())], names=names)

    return joined.groupBy(key).applyInArrow(fold, f"`{key}` {digests.schema[key].dataType.simpleString()}, {_HEADS}")


def append_blocks(rows: DataFrame, columns: Sequence[str], key: str = "segment", heads: DataFrame | None = None, block_rows: int = 4096, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The rows with their block numbers, and the heads of the new blocks: a two-level chain.

    Rows of a segment are cut by time into blocks of ``block_rows``, which are hashed in parallel; only the blocks'
    digests are chained, so a hot segment is many tasks. ``heads`` are those stored so far: appending reads them
    and no stored row, starts a new block, and raises BackdatedRows where a row is not later than its segment's
    last. Times of a segment must be distinct. ``chunk`` is a span of ``t`` whose rows one task numbers.
    """
    numbered = ordinals(rows, (key,), chunk)
    block = F.floor((F.col("n") - 1) / block_rows).cast("long")
    if heads is None:
        dealt = numbered.withColumn("block", block)
    else:
        stored = heads.groupBy(key).agg(F.max("block").alias("_last"), F.max("last_t").alias("_last_t"))
        joined = numbered.join(stored, key, "left")
        if not joined.where("t <= _last_t").isEmpty():
            raise BackdatedRows("rows to append are not later than what is stored")
        dealt = joined.withColumn("block", block + F.coalesce(F.col("_last") + 1, F.lit(0)))
    dealt = dealt.select(*rows.columns, "block")
    return dealt, _with_heads(_digests(dealt, columns, key), key, heads)


def verify_blocks(rows: DataFrame, heads: DataFrame, columns: Sequence[str], key: str = "segment") -> DataFrame:
    """(key, block, fault) of a two-level ledger: rows that are missing, foreign or changed, heads that do not follow from
    the digests, blocks that are not later than the one before."""
    found = _digests(rows, columns, key).select(key, "block", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    w = Window.partitionBy(key).orderBy("block")
    before = heads.withColumns({"_before": F.coalesce(F.lag("head").over(w), F.lit(GENESIS)), "_earlier": F.lag("last_t").over(w), "_number": F.row_number().over(w) - 1})
    joined = before.join(found, [key, "block"], "full")
    fault = (
        F.when(F.col("digest").isNull(), "UNKNOWN_BLOCK").when(F.col("_digest").isNull(), "MISSING_BLOCK").when(F.col("_rows") != F.col("rows"), "ROW_COUNT").when(F.col("_digest") != F.col("digest"), "CHANGED_BLOCK")
        .when(F.sha2(F.concat("_before", F.lit("|"), "digest"), 256) != F.col("head"), "BROKEN_HEAD").when((F.col("_number") != F.col("block")) | (F.col("_earlier") >= F.col("first_t")), "TIME_NOT_INCREASING")
    )
    return joined.select(key, "block", fault.alias("fault")).where("fault IS NOT NULL")


def outcomes(predictions: DataFrame, observations: DataFrame) -> DataFrame:
    """Predictions (series, t, pred) with the observed return over the exactly next hour; others stay out."""
    now = observations.select("series", "t", F.col("close").alias("close"))
    after = observations.select("series", (F.col("t") - 3600).alias("t"), F.col("close").alias("next_close"))
    return predictions.join(now, ["series", "t"]).join(after, ["series", "t"]).withColumn("actual", F.ln(F.col("next_close") / F.col("close")))


def period_means(rows: DataFrame, column: str, start: int, days: int = 30, periods: int = 6) -> DataFrame:
    """Means over consecutive blocks of days from ``start``, empty blocks included, and how many are positive."""
    size = days * 86_400
    block = F.floor((F.col("t") - start) / size)
    means = rows.withColumn("block", block).where((block >= 0) & (block < periods)).groupBy("series", "block").agg(F.count("*").alias("n"), F.avg(column).alias("mean"))
    spine = rows.select("series").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods - 1).cast("long"))))
    joined = spine.join(means, ["series", "block"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("positive_blocks", F.sum(F.coalesce(F.col("mean") > 0, F.lit(False)).cast("int")).over(Window.partitionBy("series")))


def decision_status(rows: DataFrame, as_of: int, holdout_from: int, through: int) -> DataFrame:
    """Whether a bar may still be predicted: only the requested newest hour, inside the holdout, and before its
    target close can be known (t + 2 h)."""
    status = F.when(F.col("t") < holdout_from, "OUTSIDE_HOLDOUT").when(F.col("t") != through, "CONTEXT").when(F.lit(as_of) >= F.col("t") + 7200, "TARGET_MAY_BE_KNOWN").otherwise("PREDICT")
    return rows.withColumn("status", status)
