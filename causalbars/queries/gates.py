"""Provenance gates and period wins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from ..sources import tables as src
from ._sql import r, rounded
from .evaluation import _FOLD_MAE, fold_mae


def provenance_gate(spark, d):
    rows = src.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", "s_name")
    faults = {"NEGATIVE_BALANCE": F.col("s_acctbal") < 0, "UNKNOWN_NATION": F.col("s_nationkey") > 20, "BAD_NAME": ~F.col("s_name").rlike("^Supplier#[0-9]{8}[0-7]$")}
    return gates.gate(rows, faults).select("s_suppkey", "failures", "verdict")


def period_wins(spark, d):
    return rounded(gates.period_wins(fold_mae(spark, d), "previous"))


QUERIES = {f.__name__: f for f in (provenance_gate, period_wins)}
ORACLES = {
    "provenance_gate": """SELECT s_suppkey, f AS failures, CASE WHEN f = '' THEN 'PASS' ELSE 'REJECT' END AS verdict FROM (SELECT s_suppkey,
      concat_ws(',', CASE WHEN coalesce(s_acctbal < 0, true) THEN 'NEGATIVE_BALANCE' END, CASE WHEN coalesce(s_nationkey > 20, true) THEN 'UNKNOWN_NATION' END, CASE WHEN coalesce(NOT regexp_matches(s_name, '^Supplier#[0-9]{8}[0-7]$'), true) THEN 'BAD_NAME' END) AS f FROM supplier)""",
    "period_wins": f"""WITH {_FOLD_MAE}, b AS (SELECT series, fold, mae AS base FROM f WHERE model = 'previous')
      SELECT series, model, count(*) AS folds, sum((mae < base)::INT)::BIGINT AS wins, {r("avg(base - mae)", "mean_margin")} FROM f JOIN b USING (series, fold) WHERE model <> 'previous' GROUP BY series, model""",
}
