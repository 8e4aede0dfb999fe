import datetime as dt

from helpers import rows
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import cost, display
from assayer.operators import report
from test_catalog import T0, catalog_row


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_costs(spark):
    cases = [(0, None, None, None), (None, None, None, None), (1024**3, 0.02, 0.02, 0.04), (1024**4, 20.48, 25.0, 45.48)]
    df = spark.createDataFrame([(c[0],) for c in cases], "n bigint")
    n = F.col("n")
    got = [tuple(r) for r in df.select(cost.storage_cost(n), cost.query_cost(n), cost.total_cost(n)).collect()]
    assert got == [c[1:] for c in cases]
    assert one(spark, F.round(cost.cost_per_gb(F.lit(1.0), F.lit(2 * 1024**3)), 4)) == 0.5
    assert one(spark, cost.cost_per_gb(F.lit(1.0), F.lit(0))) is None


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1536, 1024**2, 5 * 1024**3]
    df = spark.createDataFrame([(s,) for s in sizes], "n bigint")
    assert [r[0] for r in df.select(display.size_text(F.col("n"))).collect()] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "1.00 MB", "5.00 GB"]


def test_fixed_points_round_ties_to_even_and_nulls_stay(spark):
    for x in (0.15, 0.35, 0.45, 0.25, 2.675, 1.005, -0.35, 1e6 + 0.45, 99.95, 0.05):
        for digits in (1, 2):
            assert one(spark, display.fixed(F.lit(x), digits)) == f"{x:.{digits}f}", (x, digits)
    assert one(spark, display.fixed(F.lit(0.125))) == "0.12" and one(spark, display.fixed(F.lit(None).cast("double"))) is None
    assert one(spark, display.number_text(F.lit(10000000.0))) == "10000000.0" and one(spark, display.number_text(F.lit(0.05))) == "0.05"


def test_timestamps(spark):
    cases = {
        "2024-01-01T10:00:00": "2024-01-01T10:00:00Z", "2024-01-01T10:00:00Z": "2024-01-01T10:00:00Z", "1704103200": "2024-01-01T10:00:00Z",
        "2024-01-01T12:00:00+02:00": "2024-01-01T10:00:00Z", "not a date": "not a date", "2024-01-01T10:00:00.5": "2024-01-01T10:00:00.500000Z",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert df.filter(~display.iso_text(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0
    assert one(spark, display.minute_text(F.lit(dt.datetime(2024, 10, 20, 9, 5)))) == "2024-10-20 09:05 UTC"


def test_descriptions(spark):
    t = lambda kind, n, c: one(spark, display.table_description("Spark", F.lit("t"), F.lit(kind), F.lit(n), F.lit(c)))
    assert t("TABLE", 1234, 1) == "Spark table 't' with 1 column containing 1,234 rows."
    assert t("VIEW", 1, 0) == "Spark view 't' containing 1 row." and t(None, None, 2) == "Spark table 't' with 2 columns."
    c = lambda name, kind, mode: one(spark, display.column_description(F.lit(name), F.lit(kind), F.lit(mode)))
    assert c("user_id", "STRING", "REQUIRED") == "User Id - Required string field"
    assert c("tags", "string", "REPEATED") == "Tags - Array of string values"
    assert c("line2addr", "bigint", None) == "Line2Addr - Bigint field"


def test_sample_cells(spark):
    assert one(spark, display.sample_text(F.array(F.lit("a" * 40), F.lit("b"), F.lit("c"), F.lit("d")))) == "a" * 30 + ", b, c"
    assert one(spark, display.sample_text(F.array(F.lit("a" * 40), F.lit("b" * 40)))) == "a" * 30 + ", " + "b" * 18 + "..."
    assert one(spark, display.sample_text(F.array().cast("array<string>"))) == ""


def test_description_in_content(spark):
    text = "# t\n\n## Description\nAll the orders.\n\n## Schema\n- x"
    assert one(spark, display.description_in(F.lit(text))) == "All the orders."
    lines = "\n".join(["# head", "", *[f"l{i}" for i in range(9)]])
    assert one(spark, display.description_in(F.lit(lines))) == "l0\nl1\nl2\nl3\nl4\nl5"
    assert one(spark, display.description_in(F.lit("# only\n"))) == "*No description available*"


def full_row(spark):
    columns = [("id", "bigint", "REQUIRED", "Key", ["1", "2"]), ("email", "string", "NULLABLE", "Mail", ["a@b.c"])]
    profiles = [("id", "numeric", "1", "9", "5.0", 9, 0.0), ("email", "string", "", "", "", 4, 40.0), ("at", "other", "", "", "", 3, 10.0)]
    return catalog_row(
        spark, T0, row_count=1234567, column_count=2, size_bytes=5 * 1024**3, has_pii=True, has_phi=True, environment="prod", description="All orders.",
        last_modified=T0, created=T0, schema=columns, column_profiles=profiles, analytical_insights=["How many?", "Who?"], labels=[("k", "v")],
        lineage=[("s.a.t", "p.d.t")] + [("p.d.t", f"p.d.x{i:02d}") for i in range(12)],
    )


def with_extras(df):
    details = "array(named_struct('column_name','id','profile_type','numeric','null_count',0L,'null_percentage',0.0D,'distinct_count',9L,'min_length',NULL,'max_length',NULL)," \
              "named_struct('column_name','email','profile_type','string','null_count',40L,'null_percentage',40.0D,'distinct_count',4L,'min_length',5L,'max_length',9L))"
    return df.selectExpr(
        "*", "'ann@x.org' AS owner_email", "'sales' AS team", "array('pii','fin') AS tags", "10.5D AS monthly_cost_usd", "4.0D AS storage_cost_usd",
        "6.5D AS query_cost_usd", "0.97D AS completeness_score", "0.8D AS freshness_score", "'low' AS volatility", "'7d' AS cache_ttl",
        "1500L AS query_count_30d", "7L AS active_users_30d", "2.345D AS avg_query_time_seconds", f"{details} AS profile_details",
    )


def test_full_report(spark):
    df = with_extras(spark.createDataFrame([full_row(spark)], schemas.CATALOG))
    text = df.select(report.markdown(df)).first()[0]
    for part in [
        "# d.t\n\n[TABLE] | [PII] | [PHI] | [PROD]", "**1,234,567** rows - **5.00 GB** - **2** columns - **$10.50/month**", "**Owner**: ann@x.org",
        "| Row Count | 1,234,567 |", "| Volatility | LOW |", "## Description\n\nAll orders.", "1. How many?\n2. Who?",
        "| email [SENSITIVE] | string | NULLABLE | Mail | a@b.c |", "- **Tags**: `pii`, `fin`", "| Storage | $4.00 |", "| **Total** | **$10.50** |", "*Cost per GB*: $2.10",
        "| email | 40 | 40.0% |\n| id | 0 | 0.0% |", "**Completeness**: 97.0% [GOOD]", "**Freshness**: 80.0% [FAIR]",
        "| id | 1.00 | 9.00 | 5.00 | 9 |", "| email | 5 | 9 | 4 |", "| at | 3 | 10.0% |", "- `s.a.t`", "- `p.d.x09`\n- *... and 2 more*",
        "**Queries (Last 30 days)**: 1,500\n**Active Users**: 7\n**Avg Query Time**: 2.35s", "**Full Path**: `p.d.t`", "*Report generated at 2024-01-01T00:00:00Z*",
    ]:
        assert part in text, part
    assert "p.d.x10" not in text


def test_totals_beyond_the_inline_names(spark):
    df = with_extras(spark.createDataFrame([full_row(spark)], schemas.CATALOG)).selectExpr("*", "1L AS upstream_total", "5012L AS downstream_total")
    assert "- *... and 5,002 more*" not in df.select(report.markdown(df)).first()[0]
    assert "- *... and 5002 more*" in df.select(report.markdown(df)).first()[0]
    assert "- ... and 5000 more in the edge table" in df.select(report.content_text(df)).first()[0]


def test_bare_report(spark):
    df = spark.createDataFrame([catalog_row(spark, T0)], schemas.CATALOG)
    text = df.select(report.markdown(df)).first()[0]
    assert "*No description available for this table.*" in text and "*No upstream sources found*" in text and "No sensitive data detected" in text
    assert "*Schema contains unknown columns*" in text and "[UNKNOWN]" in text
    for absent in ("## Cost Analysis", "## Data Quality", "## Column Profiles", "## Usage Patterns", "nu", "None"):
        assert absent not in text.replace("unknown", ""), absent


def test_content_text(spark):
    df = with_extras(spark.createDataFrame([full_row(spark)], schemas.CATALOG))
    text = df.select(report.content_text(df)).first()[0]
    for part in [
        "- **Rows**: 1,234,567\n- **Size**: 5.00 GB\n- **Columns**: 2", "## Description\nAll orders.", "- **email** (string, NULLABLE): Mail — Examples: 'a@b.c'",
        "- **email**: 40.0% null\n- **at**: 10.0% null", "- **id**: min=1, max=9, avg=5.00, distinct=9", "- **email**: length=5-9, distinct=4",
        "- **Completeness**: 97.0%", "- s.a.t", "- p.d.x11", "- **Classification**: Contains PII data", "- **Labels**: k=v", "- **Total**: $10.50/month",
        "Questions that could be answered using this table:\n1. How many?",
    ]:
        assert part in text, part
    made = report.documents(df).first()
    assert made.id == "p.d.t" and made.structData.row_count == 1234567 and made.content.text == text and made.structData.tags == ["pii", "fin"]
    lines = rows(report.query_ready(df, report.reports(df)), "owner_email", "table_id")
    assert lines == [("ann@x.org", "t")]
