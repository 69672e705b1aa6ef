"""Order-book microstructure: depth features by array functions, changes since the previous snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bps, imbalance


def _sum(levels: Column, value) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda total, x: total + value(x))


def valid_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots with depth on both sides and an ask above the bid."""
    return snapshots.where((F.size("bids") > 0) & (F.size("asks") > 0) & (F.get("asks", 0)["price"] > F.get("bids", 0)["price"]))


def depth_features(snapshots: DataFrame) -> DataFrame:
    """24 features of each snapshot (bids and asks: arrays of price and quantity, best first)."""
    bids, asks = F.col("bids"), F.col("asks")
    bid, ask = F.get(bids, 0), F.get(asks, 0)
    bq, aq, mid = bid["quantity"], ask["quantity"], (bid["price"] + ask["price"]) / 2
    depth = {f"{s}_depth_{n}": _sum(F.slice(levels, 1, n), lambda x: x["quantity"]) for n in (3, 5) for s, levels in (("bid", bids), ("ask", asks))}
    staged = snapshots.withColumns({"mid": mid, "spread": ask["price"] - bid["price"], **depth})
    micro = F.try_divide(ask["price"] * bq + bid["price"] * aq, bq + aq)
    m = F.col("mid")

    def vwap(side: str, levels: Column) -> Column:
        return F.try_divide(_sum(F.slice(levels, 1, 5), lambda x: x["price"] * x["quantity"]), F.col(f"{side}_depth_5"))

    def distance(side: str, levels: Column) -> Column:
        return bps(F.try_divide(_sum(F.slice(levels, 1, 5), lambda x: F.abs(x["price"] - m) * x["quantity"]), F.col(f"{side}_depth_5")), m)

    def slope(side: str, levels: Column) -> Column:
        top = F.slice(levels, 1, 5)
        return F.when(F.size(top) < 2, 0.0).otherwise(F.coalesce(F.try_divide(bps(F.abs(F.get(top, 0)["price"] - F.element_at(top, -1)["price"]), m), F.col(f"{side}_depth_5")), F.lit(0.0)))

    named = {
        "spread_bps": bps(F.col("spread"), m), "top_bid_quantity": bq, "top_ask_quantity": aq, "top_quantity_imbalance": imbalance(bq, aq), "log_top_quantity_ratio": F.ln(F.try_divide(bq, aq)),
        "depth_imbalance_3": imbalance(F.col("bid_depth_3"), F.col("ask_depth_3")), "depth_imbalance_5": imbalance(F.col("bid_depth_5"), F.col("ask_depth_5")),
        "microprice": micro, "microprice_minus_mid_bps": bps(micro - m, m), "visible_bid_levels": F.size(bids).cast("double"), "visible_ask_levels": F.size(asks).cast("double"),
    }
    for side, levels in (("bid", bids), ("ask", asks)):
        named |= {f"{side}_vwap_5": vwap(side, levels), f"{side}_depth_distance_bps": distance(side, levels), f"{side}_slope_bps": slope(side, levels)}
    if "access_mode" in snapshots.columns:
        named |= {"authenticated_quote_flag": (F.col("access_mode") == "AUTHENTICATED_READ_ONLY").cast("double"), "public_cached_quote_flag": (F.col("freshness_status") == "SERVER_CACHED_LESS_CURRENT").cast("double")}
    return staged.withColumns(named)


def changes(features: DataFrame, key: str = "security") -> DataFrame:
    """Six changes since the strictly earlier snapshot of the same key; zeros where there is none."""
    w = Window.partitionBy(key).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)  # earlier times only
    before = F.max(F.struct("t", "mid", "spread_bps", "depth_imbalance_5", "microprice_minus_mid_bps")).over(w)
    staged = features.withColumn("_p", before)
    has = F.col("_p").isNotNull()

    def since(x: Column) -> Column:
        return F.when(has, x).otherwise(0.0)

    named = {"has_previous_snapshot": has.cast("double"), "seconds_since_previous": since((F.col("t") - F.col("_p.t")).cast("double")), "mid_log_return_since_previous": since(F.ln(F.col("mid") / F.col("_p.mid")))}
    named |= {f"{n}_change": since(F.col(n) - F.col(f"_p.{n}")) for n in ("spread_bps", "depth_imbalance_5", "microprice_minus_mid_bps")}
    return staged.withColumns(named).drop("_p")


def levels_table(snapshots: DataFrame, key: str = "security") -> DataFrame:
    """The normalised form: one row a level, numbered from 1 by side."""
    sides = [snapshots.select(key, "t", F.lit(s).alias("side"), F.posexplode(c).alias("i", "x")) for s, c in (("bid", "bids"), ("ask", "asks"))]
    return sides[0].unionByName(sides[1]).select(key, "t", "side", (F.col("i") + 1).alias("level_index"), "x.price", "x.quantity")


def snapshots_of(levels: DataFrame, key: str = "security") -> DataFrame:
    """Snapshots rebuilt from their levels."""

    def side(s: str) -> Column:
        own = F.collect_list(F.when(F.col("side") == s, F.struct("level_index", "price", "quantity")))
        return F.transform(F.array_sort(own), lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity")))

    return levels.groupBy(key, "t").agg(side("bid").alias("bids"), side("ask").alias("asks"))
