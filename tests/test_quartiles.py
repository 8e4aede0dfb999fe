from decimal import Decimal
import math
import random

import pytest

from assayer.operators import quartiles


def plain(values, p):
    """The value at place ceil(p n) of the sorted values; not a number comes last."""
    held = sorted((float(v) for v in values if v is not None), key=lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v))
    return held[max(1, math.ceil(p * len(held))) - 1] if held else None


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


COLUMNS = {
    "spread": ("double", lambda r, i: r.gauss(0, 1000)),
    "few": ("int", lambda r, i: r.choice([1, 1, 1, 5, 9])),
    "skewed": ("bigint", lambda r, i: 7 if r.random() < 0.4 else int(r.paretovariate(0.3)) % 10**15),
    "ordered": ("int", lambda r, i: i),
    "gaps": ("double", lambda r, i: None if r.random() < 0.5 else r.random()),
    "odd": ("double", lambda r, i: r.choice([float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1e-300, r.random()])),
    "mostly_nan": ("double", lambda r, i: float("nan") if r.random() < 0.9 else r.random()),
    "money": ("decimal(12,2)", lambda r, i: Decimal(r.randrange(10**9)).scaleb(-2)),
    "same": ("smallint", lambda r, i: 3),
    "none": ("int", lambda r, i: None),
}


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    data = [tuple(make(r, i) for _, make in COLUMNS.values()) for i in range(3000)]
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in COLUMNS.items())
    return data, spark.createDataFrame(data, schema).repartition(7).cache()


# few rows make every column pass through rounds; a poor sketch makes proposals that the counts refuse
@pytest.mark.parametrize("few, sketch_k", [(20_000, 2_000), (5, 2_000), (100, 50)])
def test_same_as_sorting(table, few, sketch_k):
    data, df = table
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = {(r["column_name"], r["quantile"]): r["value"] for r in quartiles.quantiles({"t": df}, probabilities, few, sketch_k).collect()}
    assert len(found) == len(COLUMNS) * len(probabilities)
    for i, name in enumerate(COLUMNS):
        for p in probabilities:
            assert same(found[name, p], plain([d[i] for d in data], p)), (name, p)


def test_several_tables_nested_columns_and_empty_ones(spark):
    nested = spark.sql("SELECT named_struct('x', id, 'name', 'a') AS s, array(1, 2) AS a, 'text' AS t FROM range(11)")
    empty = spark.createDataFrame([], "n int, t string")
    found = quartiles.quartiles({"nested": nested, "empty": empty, "texts": spark.createDataFrame([("a",)], "t string")})
    assert sorted(map(tuple, found.collect())) == [("empty", "n", None, None, None), ("nested", "s.x", 2.0, 5.0, 8.0)]
    assert quartiles.quantiles({"texts": spark.createDataFrame([("a",)], "t string")}).count() == 0
    with pytest.raises(ValueError):
        quartiles.quantiles({"nested": nested}, (1.5,))
