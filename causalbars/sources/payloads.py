"""Decoding landed payloads: delta-compressed candles, candle JSON, order-book XML, minute archives, chart files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeops import HOUR

MULTIPLIER = 0.01


PRICES = ("open", "high", "low", "close")


def encode_deltas(bars: DataFrame) -> DataFrame:
    """One payload a series and day: start and shift in milliseconds, multiplier, first prices, and integer deltas of
    times (in shifts) and prices (in multiplier units); the first deltas are 0."""
    day = F.floor(F.col("t") / (24 * HOUR))
    named = {x: F.round(F.col(x) / MULTIPLIER).cast("long") for x in PRICES}
    listed = F.array_sort(F.collect_list(F.struct("t", *[v.alias(k) for k, v in named.items()])))
    days = bars.groupBy("series", day.alias("day")).agg(listed.alias("p"))

    def deltas(field: str) -> Column:
        return F.transform("p", lambda x, i: x[field] - F.when(i == 0, x[field]).otherwise(F.get("p", i - 1)[field]))

    times = F.transform("p", lambda x, i: F.when(i == 0, F.lit(0)).otherwise(((x["t"] - F.get("p", i - 1)["t"]) / HOUR).cast("long")))
    bases = [(F.get("p", 0)[f] * MULTIPLIER).alias(f) for f in PRICES]
    return days.select("series", "day", (F.get("p", 0)["t"] * 1000).alias("timestamp"), F.lit(HOUR * 1000).cast("long").alias("shift"), F.lit(MULTIPLIER).alias("multiplier"), *bases, times.alias("times"), *[deltas(f).alias(f"{f}s") for f in PRICES])


def decode_deltas(payloads: DataFrame, zero: bool = False) -> DataFrame:
    """Bars of payloads: first prices in whole multiplier units, plus running sums of the deltas; real gaps stay gaps.

    A payload without times has no bars. Raised are: arrays of other lengths than ``times``, a shift that is not an
    hour, negative time deltas, a multiplier or first price that is not positive and finite, a bar that is not at a
    whole hour, and prices that are not positive or not an OHLC bar. A repeated payload is decoded each time. With
    ``zero``, prices may be 0 as well, as values of events are.
    """
    plural = [f"{f}s" for f in PRICES]
    priced = lambda c: (c >= 0) if zero else (c > 0)
    finite = lambda c: c.isNotNull() & (c < float("inf"))  # noqa: E731  NaN sorts above infinity
    good = (F.col("shift") == HOUR * 1000) & finite(F.col("multiplier")) & (F.col("multiplier") > 0) & ~F.exists("times", lambda x: x.isNull() | (x < 0))
    for f in plural:
        good = good & (F.size(f) == F.size("times")) & ~F.exists(f, lambda x: x.isNull())
    for f in PRICES:
        good = good & finite(F.col(f)) & priced(F.col(f))
    filled = payloads.where(F.size("times") > 0).withColumn("_payload", F.monotonically_increasing_id())
    checked = filled.withColumn("times", F.when(F.coalesce(good, F.lit(False)), F.col("times")).otherwise(F.raise_error(F.lit("bad payload"))))
    units = [F.round(F.col(f) / F.col("multiplier")).cast("long").alias(f"_{f}") for f in PRICES]
    keyed = checked.select("series", "_payload", "timestamp", "shift", "multiplier", *units, F.posexplode(F.arrays_zip("times", *plural)).alias("i", "x"))
    w = Window.partitionBy("_payload").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    prices = [((F.col(f"_{f}") + F.sum(f"x.{f}s").over(w)) * F.col("multiplier")).alias(f) for f in PRICES]
    bars = keyed.select("series", (F.col("timestamp") + F.sum("x.times").over(w) * F.col("shift")).alias("_ms"), *prices)
    valid = (F.col("_ms") % (HOUR * 1000) == 0) & priced(F.col("low")) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    t = F.when(valid, F.floor(F.col("_ms") / 1000)).otherwise(F.raise_error(F.lit("bad bar in a payload")))
    return bars.select("series", t.cast("long").alias("t"), *PRICES)


def epoch_of(value: Column) -> Column:
    """Seconds of a text timestamp in seconds, milliseconds or ISO form."""
    number = value.try_cast("double")
    iso = F.unix_micros(F.try_to_timestamp(value)) / 1_000_000
    return F.coalesce(F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number), iso).cast("long")


def candles_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Bars of JSON payloads: rows under data, prices, candles or items; alternative field names; bad rows dropped."""
    row = "struct<timestamp: string, time: string, t: string, open: string, o: string, high: string, h: string, low: string, l: string, close: string, c: string>"
    parsed = raw.withColumn("_j", F.from_json(column, "struct<" + ", ".join(f"{k}: array<{row}>" for k in ("data", "prices", "candles", "items")) + ">"))
    rows = parsed.select(F.explode(F.coalesce(*[F.col(f"_j.{k}") for k in ("data", "prices", "candles", "items")])).alias("r"))
    named = {full: F.coalesce(F.col(f"r.{full}"), F.col(f"r.{full[0]}")).try_cast("double") for full in ("open", "high", "low", "close")}
    done = rows.select(epoch_of(F.coalesce("r.timestamp", "r.time", "r.t")).alias("t"), *[v.alias(k) for k, v in named.items()])
    return done.dropna()


def book_from_xml(raw: DataFrame, column: str = "value") -> DataFrame:
    """Order-book levels of XML documents: bids by falling, asks by rising price; crossed books are dropped.

    Documents with a document type or entities are refused before parsing.
    """
    safe = raw.where(~F.upper(F.col(column)).contains("<!DOCTYPE") & ~F.upper(F.col(column)).contains("<!ENTITY"))
    level = "array<struct<_price: double, _quantity: double>>"
    parsed = safe.withColumn("_x", F.from_xml(column, f"struct<_securityId: string, _currency: string, bid: {level}, ask: {level}>"))

    def levels(side: str, falling: bool) -> Column:
        good = F.filter(f"_x.{side}", lambda x: (x["_price"] > 0) & (x["_quantity"] > 0))
        pairs = F.transform(good, lambda x: F.struct(x["_price"].alias("price"), x["_quantity"].alias("quantity")))
        return F.sort_array(pairs, asc=not falling)

    books = parsed.select(F.col("_x._securityId").alias("security_id"), F.col("_x._currency").alias("currency"), levels("bid", True).alias("bids"), levels("ask", False).alias("asks"))
    return books.where((F.size("bids") > 0) & (F.size("asks") > 0) & (F.get("asks", 0)["price"] > F.get("bids", 0)["price"]))


def file_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Files by content: byte-identical copies count once; the canonical name has no "(", is short, sorts first."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))
    name = F.element_at(F.split("path", "/"), -1)
    order = Window.partitionBy("sha256").orderBy(F.instr(name, "(") > 0, F.length(name), name)
    return files.withColumns({"name": name, "nth": F.row_number().over(order), "copies": F.count("*").over(Window.partitionBy("sha256"))}).where("nth = 1").drop("nth")


def zipped_lines(spark: SparkSession, folder: str, prefer: str = "M1") -> DataFrame:
    """(archive, row_no, line) of the text member of each ZIP: members named STATUS are skipped, ``prefer`` wins."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def unzip(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [m for m in archive.namelist() if "STATUS" not in m.upper() and m.lower().endswith((".csv", ".txt"))]
                    if members:
                        chosen = sorted(members, key=lambda m: (prefer not in m.upper(), m))[0]
                        lines = [x for x in archive.read(chosen).decode("utf-8").splitlines() if x.strip()]
                        yield pd.DataFrame({"archive": path, "row_no": range(len(lines)), "line": lines})

    return files.mapInPandas(unzip, "archive string, row_no long, line string")


def semicolon_minutes(lines: DataFrame) -> DataFrame:
    """Minute rows of ``YYYYMMDD HHMMSS;o;h;l;c;v`` lines in fixed EST (UTC-5, no daylight saving)."""
    return _minute_columns(lines, F.split("line", ";"), 0, "yyyyMMdd HHmmss", 5)


def comma_minutes(lines: DataFrame, symbol: str) -> DataFrame:
    """Minute rows of ``SYMBOL,YYYYMMDDHHMM,o,h,l,c,v`` lines; another symbol raises."""
    parts = F.split("line", ",")
    own = F.upper(F.trim(F.get(parts, 0))) == symbol.upper()
    checked = lines.withColumn("line", F.when(own, F.col("line")).otherwise(F.raise_error(F.lit("unexpected symbol"))))
    return _minute_columns(checked, parts, 1, "yyyyMMddHHmm", 5)


def _minute_columns(lines: DataFrame, parts: Column, at: int, pattern: str, hours: int) -> DataFrame:
    t = F.unix_micros(F.try_to_timestamp(F.trim(F.get(parts, at)), F.lit(pattern))) / 1_000_000 + hours * HOUR
    prices = [F.get(parts, at + i).try_cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)]
    return lines.select("archive", "row_no", t.cast("long").alias("t"), *prices)


def month_plan(start: str, end: str, earliest: str, spark: SparkSession) -> DataFrame:
    """Months to scan from ``start`` to ``end``, not before ``earliest``; the last one is marked active."""
    return spark.sql(f"SELECT explode(sequence(trunc(greatest(date'{start}', date'{earliest}'), 'MM'), trunc(date'{end}', 'MM'), INTERVAL 1 MONTH)) AS month").withColumn("active", F.col("month") == F.trunc(F.lit(end).cast("date"), "MM"))


def chunk_range(start_t: int, end_t: int, hours: int, spark: SparkSession) -> DataFrame:
    """[from_t, to_t) pieces of at most ``hours`` that cover a range."""
    return spark.range(start_t, end_t, hours * HOUR).select(F.col("id").alias("from_t"), F.least(F.col("id") + hours * HOUR, F.lit(end_t)).alias("to_t"))


def chart_audit(bars: DataFrame, interval: int, exported_t: int) -> DataFrame:
    """Per-series audit of descending chart rows (series, row_no, t, high, low, close).

    Counts duplicates, rows out of descending order, steps that are not the interval, bad and flat rows, and says
    whether the newest bucket was still open at export.
    """
    w = Window.partitionBy("series").orderBy("row_no")
    step = F.lag("t").over(w) - F.col("t")
    bad = ~((F.col("low") > 0) & (F.col("high") >= F.col("low")) & F.col("close").between(F.col("low"), F.col("high")))
    rows = bars.withColumns({"_step": step, "_bad": F.coalesce(bad, F.lit(True)), "_flat": F.col("high") == F.col("low")})
    total = lambda x: F.sum(x.cast("int"))
    return rows.groupBy("series").agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("t")).alias("duplicates"), total(F.coalesce(F.col("_step") <= 0, F.lit(False))).alias("out_of_order"), total(F.coalesce(F.col("_step") != interval, F.lit(False))).alias("wrong_steps"), total(F.col("_bad")).alias("bad_rows"), total(F.col("_flat")).alias("flat_rows"), (F.lit(exported_t) - F.max("t") < interval).alias("newest_open"))


def yearly_positions(rows: DataFrame, code: str, date_names: tuple[str, ...]) -> DataFrame:
    """Rows of one zero-padded market code, dated by the first alias present; the last row of a date wins."""
    dates = [F.col(n) for n in date_names if n in rows.columns]
    own = rows.where(F.lpad(F.trim("code"), 6, "0") == code).withColumn("report_date", F.coalesce(*dates).cast("date"))
    return own.groupBy("report_date").agg(F.max_by(F.struct(*[c for c in own.columns if c != "report_date"]), "row_no").alias("_r")).select("report_date", "_r.*")
