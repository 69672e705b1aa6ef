"""Building blocks of the oracle SQL, and the rounding that both sides share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
#: Added before rounding: the engines break exact ties differently.
NUDGE = 1e-9

#: Ticks and hourly bars of each event type.
BARS = """ticks AS (SELECT event_type AS series, epoch_us(ts) // 1000000 AS t, event_id AS k, value AS price, user_id FROM events),
bars AS (SELECT series, t // 3600 * 3600 AS t, arg_min(price, (t, k)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (t, k)) AS close, count(*) AS n_ticks,
  CASE WHEN count(*) >= 2 THEN 'OK' ELSE 'PARTIAL_SOURCE_HOUR' END AS quality FROM ticks GROUP BY series, t // 3600 * 3600)"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits (and no negative zero), so the order of sums does not show."""
    return df.select(*[(F.round(F.col(f"`{c}`") + F.lit(NUDGE), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE + {NUDGE}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS {name}"


def rs(named: dict[str, str]) -> str:
    return ", ".join(r(x, n) for n, x in named.items())


def lag(x: str, hours: int, by: str = "series") -> str:
    return f"max({x}) OVER (PARTITION BY {by} ORDER BY t RANGE BETWEEN {hours * 3600} PRECEDING AND {hours * 3600} PRECEDING)"


def lead(x: str, hours: int, by: str = "series") -> str:
    return f"max({x}) OVER (PARTITION BY {by} ORDER BY t RANGE BETWEEN {hours * 3600} FOLLOWING AND {hours * 3600} FOLLOWING)"


def roll(agg: str, x: str, hours: int, least: int, by: str = "series") -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY t RANGE BETWEEN {hours * 3600 - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {agg}({x}) {w} END"


def pos(agg: str, x: str, rows: int, order: str = "t", by: str = "series") -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {rows} THEN {agg}({x}) {w} END"


def shift(x: str, rows: int, order: str = "t", by: str = "series") -> str:
    return f"lag({x}, {rows}) OVER (PARTITION BY {by} ORDER BY {order})"


def corr(a: str, b: str, hours: int, least: int) -> str:
    w = f"OVER (PARTITION BY series ORDER BY t RANGE BETWEEN {hours * 3600 - 1} PRECEDING AND CURRENT ROW)"
    a, b = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"CASE WHEN count({a}) {w} >= {least} THEN covar_pop({a}, {b}) {w} / nullif(stddev_pop({a}) {w} * stddev_pop({b}) {w}, 0) END"


def base_least(hours: int) -> int:
    return max(2, -(-hours // 2))


def cross_least(hours: int) -> int:
    return max(4, -(-hours // 2))


def ridge(name: str, source: str, keys: str, features: list[str], label: str, alpha: float) -> str:
    """CTEs that end in ``name`` (keys, o, w_<feature>): a ridge on standardised features of each group of ``source``,
    by elimination written out."""
    k, at = len(features), list(enumerate(features))
    sums = [f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) < 1e-12 THEN 1 ELSE stddev_pop({f}) END AS s{i}, covar_pop({f}, {label}) AS b{i}" for i, f in at]
    sums += [f"covar_pop({f}, {g}) AS c{i}_{j}" for i, f in at for j, g in at if i <= j]
    ctes = [f"{name}_m AS (SELECT {keys}, count(*) AS n, avg({label}) AS my{''.join(f', {x}' for x in sums)} FROM {source} GROUP BY {keys})"]
    kept = f"{keys}, my{''.join(f', m{i}, s{i}' for i in range(k))}"
    cells = [f"n * c{min(i, j)}_{max(i, j)} / (s{i} * s{j}){f' + {alpha}' if i == j else ''} AS a{i}_{j}" for i in range(k) for j in range(k)] + [f"n * b{i} / s{i} AS a{i}_{k}" for i in range(k)]
    ctes.append(f"{name}_0 AS (SELECT {kept}{''.join(f', {x}' for x in cells)} FROM {name}_m)")
    for p in range(k - 1):
        cells = [f"a{i}_{j}" if i <= p else f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" for i in range(k) for j in range(min(i, p + 1), k + 1) if i <= p or j > p]
        ctes.append(f"{name}_{p + 1} AS (SELECT {kept}, {', '.join(cells)} FROM {name}_{p})")
    last = f"{name}_{max(k - 1, 0)}"
    for i in reversed(range(k)):  # back substitution, one unknown a step
        known = "".join(f" - a{i}_{j} * z{j}" for j in range(i + 1, k))
        ctes.append(f"{name}_z{i} AS (SELECT *, (a{i}_{k}{known}) / a{i}_{i} AS z{i} FROM {last})")
        last = f"{name}_z{i}"
    weights = "".join(f", z{i} / s{i} AS w_{f}" for i, f in at)
    ctes.append(f"{name} AS (SELECT {keys}, my{''.join(f' - z{i} / s{i} * m{i}' for i in range(k))} AS o{weights} FROM {last})")
    return ",\n".join(ctes)


def line(table: str, features: list[str], rows: str = "") -> str:
    """The prediction of a model from :func:`ridge`."""
    at = f"{rows}." if rows else ""
    return f"{table}.o" + "".join(f" + {table}.w_{f} * {at}{f}" for f in features)
