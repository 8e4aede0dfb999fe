"""Exact quantiles of every numeric column at any size, by selection through refinement.

For each quantile a bracket of values is known to hold it: the rows below the bracket and inside it are counted. A scan counts both for
a narrower bracket, and sketches what lies inside, which proposes the next one. A proposal that the counts do not confirm costs a
round, never a wrong result. Each round narrows a bracket to about a hundredth of its rows; once it holds few, their values are counted
and the quantile is read from the running count. No value is sorted or shuffled before that.

Values are compared as doubles, which keeps the order of all numbers, so the result is the exact quantile as a double.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from assayer.functions import sqltext as q
from assayer.operators.profile import unsigned_zero
from assayer.sources.tables import Field, profilable, union_all

#: Size of the sketch that proposes a bracket; a rank is rarely off by more than ``4 / k`` of the rows.
SKETCH_K = 2_000
#: Parts into which the sketch cuts a bracket.
PARTS = 256
#: Rows of a bracket whose values are counted one by one.
FEW_ROWS = 20_000
RESULT = "table_id string, column_name string, ordinal int, quantile double, value double"


@dataclass
class _Target:
    """One quantile of one column: the bracket that is known to hold it, and the one to try next (at first all numbers)."""

    table_id: str
    column: Field
    quantile: float
    rank: int | None = None
    low: float = -math.inf
    high: float = math.nan  # above every number
    below: int = 0
    inside: int = 0
    tried: tuple[float, float] = (-math.inf, math.nan)

    @property
    def number(self) -> str:
        c = q.name(self.column.path)
        return f"CAST({unsigned_zero(c, self.column.data_type)} AS DOUBLE)"

    def within(self, low: float, high: float) -> str:
        return f"{self.number} >= {_literal(low)} AND {self.number} <= {_literal(high)}"

    def open(self, few: int) -> bool:
        return self.rank is None or (self.inside > few and not _same(self.low, self.high))


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


def _literal(x: float) -> str:
    """A double as SQL; not a number is the largest of all, as in Spark's order."""
    special = "NaN" if math.isnan(x) else "Infinity" if x == math.inf else "-Infinity" if x == -math.inf else repr(x)
    return f"CAST('{special}' AS DOUBLE)"


def _before(x: float) -> float:
    return math.inf if math.isnan(x) else math.nextafter(x, -math.inf)


def _after(x: float) -> float:
    return math.nan if x == math.inf else math.nextafter(x, math.inf)


def quantiles(
    tables: dict[str, DataFrame], probabilities: tuple[float, ...] = (0.25, 0.5, 0.75), few: int = FEW_ROWS, sketch_k: int = SKETCH_K, columns_per_pass: int = 2
) -> DataFrame:
    """The smallest value that has at least the given share of a column's filled cells at or below it (schema ``RESULT``).

    Every numeric column of every table; columns without a value give null. Not-a-number is the largest number. The driver sees one row a
    column and round. ``few`` and ``sketch_k`` decide how many scans are needed, not the result.
    """
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must lie between 0 and 1")
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    targets = [
        _Target(name, f, p) for name, df in tables.items() for f in profilable(df.schema) if isinstance(f.data_type, T.NumericType) for p in probabilities
    ]
    if not targets:
        return spark.createDataFrame([], RESULT)
    while left := [t for t in targets if t.open(few)]:
        _round(tables, left, sketch_k, columns_per_pass)
    return _selected(spark, tables, targets)


def _passes(targets: list[_Target], columns_per_pass: int) -> list[list[_Target]]:
    """Targets by table, a few columns at a time: a pass reads only its own columns."""
    out: list[list[_Target]] = []
    by_table: dict[str, list[_Target]] = {}
    for t in targets:
        by_table.setdefault(t.table_id, []).append(t)
    for mine in by_table.values():
        paths = list(dict.fromkeys(t.column.path for t in mine))
        for i in range(0, len(paths), columns_per_pass):
            chosen = set(paths[i : i + columns_per_pass])
            out.append([t for t in mine if t.column.path in chosen])
    return out


def _scan(tables: dict[str, DataFrame], targets: list[_Target], sketch_k: int, columns_per_pass: int) -> list:
    """Count what is tried for each target and sketch what lies inside, as one job. One row a target comes back, in their order."""
    # one short constant, read once, in place of an array of literals for each quantile
    parts = f"CAST(split('{','.join(str(i / PARTS) for i in range(PARTS + 1))}', ',') AS ARRAY<DOUBLE>)"
    place = {id(t): i for i, t in enumerate(targets)}
    frames = []
    for mine in _passes(targets, columns_per_pass):
        names: dict[str, str] = {}  # quantiles of a column that still share a bracket share its aggregates
        structs = []
        for t in mine:
            inside = t.within(*t.tried)
            wanted = [
                f"count_if({t.within(t.low, t.high)} AND {t.number} < {_literal(t.tried[0])})",
                f"count_if({inside})",
                f"kll_sketch_agg_double(CASE WHEN {inside} THEN {t.number} END, {sketch_k})",
            ]
            below, held, sketch = (names.setdefault(agg, f"_{len(names)}") for agg in wanted)
            n = f"coalesce(kll_sketch_get_n_double({sketch}), 0L)"
            cuts = f"CASE WHEN {n} > 0 THEN kll_sketch_get_quantile_double({sketch}, {parts}) END"
            structs.append(q.struct(place=str(place[id(t)]), below=below, inside=held, n=n, cuts=cuts))
        found = tables[mine[0].table_id].selectExpr(*(f"{agg} AS {name}" for agg, name in names.items()))
        frames.append(found.selectExpr(q.rows(structs)))
    return sorted(union_all(frames).collect(), key=lambda r: r["place"])


def _round(tables: dict[str, DataFrame], targets: list[_Target], sketch_k: int, columns_per_pass: int) -> None:
    """One scan: the brackets that the counts confirm are taken, and the next ones proposed."""
    for t, found in zip(targets, _scan(tables, targets, sketch_k, columns_per_pass)):
        below, inside = found["below"], found["inside"]
        if t.rank is None:
            t.inside, t.rank = inside, min(inside, max(1, math.ceil(Fraction(str(t.quantile)) * inside)))
        low, high = t.tried
        if below and t.rank <= t.below + below:
            t.high, t.inside = _before(low), below
        elif t.rank > t.below + below + inside:
            t.low, t.below, t.inside = _after(high), t.below + below + inside, t.inside - below - inside
        else:
            t.low, t.high, t.below, t.inside = low, high, t.below + below, inside
            t.tried = _narrower(t, found["n"], found["cuts"], 4 / sketch_k)
            continue
        t.tried = t.low, t.high  # not confirmed: the part that holds the quantile is sketched anew


def _narrower(t: _Target, n: int, cuts: list[float] | None, error: float) -> tuple[float, float]:
    """The parts around the rank, by the sketch's error, or without it where the bracket would stay as it is; else its lowest value is tried, so every round gains.

    The sketch passes over what is not a number, which comes after its ``n`` values.
    """
    nth = t.rank - t.below
    if nth > n or not n:  # also a column without a value
        return math.nan, math.nan
    for slack in (error, 0.0):
        low = cuts[max(0, math.floor((nth / n - slack) * PARTS))]
        high = cuts[min(PARTS, math.ceil((nth / n + slack) * PARTS))]
        if not (_same(low, t.low) and _same(high, t.high)):
            return low, high
    return low, low


def _selected(spark: SparkSession, tables: dict[str, DataFrame], targets: list[_Target]) -> DataFrame:
    """Brackets with few rows: their values are counted, and the first whose running count reaches the rank is the quantile."""
    brackets: dict[tuple, int] = {}  # quantiles that share a bracket share its values
    rows, searched = [], []
    for t in targets:
        known = t.rank == 0 or _same(t.low, t.high)
        bracket = None
        if not known:
            key = (t.table_id, t.column.path, t.low, t.high if t.high == t.high else None)
            if key not in brackets:
                searched.append(t)
            bracket = brackets.setdefault(key, len(brackets))
        value = t.low if known and t.rank else None
        rows.append((bracket, t.table_id, t.column.dotted, t.column.ordinal, t.quantile, t.rank - t.below, value))
    wanted = spark.createDataFrame(rows, "bracket int, table_id string, column_name string, ordinal int, quantile double, nth bigint, known double")
    if not searched:
        return wanted.selectExpr("table_id", "column_name", "ordinal", "quantile", "known AS value")
    number = {id(t): i for i, t in enumerate(searched)}
    frames = []
    for mine in _passes(searched, 1_000_000):
        cells = [f"CASE WHEN {t.within(t.low, t.high)} THEN named_struct('bracket', {number[id(t)]}, 'value', {t.number}) END" for t in mine]
        frames.append(tables[mine[0].table_id].selectExpr(f"inline(array_compact(array({', '.join(cells)})))"))
    counted = union_all(frames).groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))  # at most ``few`` values a bracket
    reached = counted.withColumn("reached", F.sum("n").over(Window.partitionBy("bracket").orderBy("value")))
    hit = (F.col("reached") >= F.col("nth")) & (F.col("reached") - F.col("n") < F.col("nth"))
    # one row a quantile
    found = reached.join(F.broadcast(wanted.select("bracket", "quantile", "nth")), "bracket").filter(hit).select("bracket", "quantile", F.col("value").alias("_value"))
    return wanted.join(found, ["bracket", "quantile"], "left").selectExpr("table_id", "column_name", "ordinal", "quantile", "coalesce(known, _value) AS value")


def quartiles(tables: dict[str, DataFrame], few: int = FEW_ROWS, sketch_k: int = SKETCH_K) -> DataFrame:
    """One row a numeric column: ``table_id``, ``column_name``, ``q1``, ``median``, ``q3``."""
    found = quantiles(tables, (0.25, 0.5, 0.75), few, sketch_k)
    at = lambda p, name: F.max(F.when(F.col("quantile") == p, F.col("value"))).alias(name)
    return found.groupBy("table_id", "column_name").agg(at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"))
