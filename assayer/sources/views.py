"""View definitions as a frame, the raw material of view lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = "view_ref string, project_id string, dataset_id string, view_id string, view_query string"


def catalog_views(spark: SparkSession, project_id: str = "spark_catalog") -> DataFrame:
    """Every stored view of the session catalog with its query text; a view that cannot be read is left out."""
    rows = []
    for database in spark.catalog.listDatabases():
        for table in spark.catalog.listTables(database.name):
            if table.tableType != "VIEW" or table.isTemporary:
                continue
            described = spark.sql(f"DESCRIBE TABLE EXTENDED `{database.name}`.`{table.name}`")
            text = described.filter("col_name = 'View Text'").select("data_type").first()
            if text:
                ref = f"{project_id}.{database.name}.{table.name}"
                rows.append((ref, project_id, database.name, table.name, text[0]))
    return spark.createDataFrame(rows, VIEWS)
