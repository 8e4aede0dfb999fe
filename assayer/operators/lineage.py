"""Lineage: references in query text, edges, graph closure, coverage and the job's own events."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.display import utc
from assayer.functions.naming import strip_scheme
from assayer.operators.selection import is_excluded
from assayer.session import cut_lineage

EDGES = "source string, target string, edge_type string"

#: Edges of one node that a task gets, about.
HUB = 50_000
#: Edges that a task of a walk reads, about.
STEPS = 1_000_000

# Comments and string literals hold no references.
_NO_CODE = r"--[^\n]*|/\*(?s:.*?)\*/|'[^']*'"
_QUOTED = r"`([^`.]+\.[^`.]+\.[^`.]+)`"
_UNQUOTED = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)?)"


def table_refs(query: Column, default_project: Column) -> Column:
    """Distinct tables a query reads: quoted three-part names, and two- or three-part names after FROM or JOIN."""
    code = F.regexp_replace(query, _NO_CODE, " ")
    joined_quotes = F.regexp_replace(code, r"`\s*\.\s*`", ".")
    quoted = F.regexp_extract_all(joined_quotes, F.lit(_QUOTED), F.lit(1))
    plain = F.transform(
        F.regexp_extract_all(code, F.lit(_UNQUOTED), F.lit(1)),
        lambda r: F.when(r.rlike(r"^[^.]+\.[^.]+$"), F.concat(default_project, F.lit("."), r)).otherwise(r),
    )
    return F.array_distinct(F.concat(quoted, plain))


def extract_refs(views: DataFrame, default_project: str = "project_id") -> DataFrame:
    """``(view_ref, table_ref)`` for every reference; a view that names itself is not its own source."""
    refs = views.select("view_ref", F.explode(table_refs(F.col("view_query"), F.col(default_project))).alias("table_ref"))
    return refs.filter(F.col("table_ref") != F.col("view_ref"))


def view_dependencies(views: DataFrame, tables: DataFrame, excluded: list[str] = []) -> DataFrame:
    """Edges from known tables to the views that read them, matched on whole names (in any case) with an equi join.

    References are made distinct inside each view, so the edges are distinct without a shuffle of their own.
    """
    kept = views.filter(~is_excluded(F.col("dataset_id"), excluded)) if excluded else views
    names = F.array_distinct(F.transform(table_refs(F.col("view_query"), F.col("project_id")), F.lower))
    refs = kept.select("view_ref", F.explode(names).alias("_key"))
    known = tables.select(F.col("table_ref").alias("source"), F.lower("table_ref").alias("_key")).distinct()
    found = refs.join(known, "_key").filter(F.col("source") != F.col("view_ref"))
    return found.select("source", F.col("view_ref").alias("target"), F.lit("view").alias("edge_type"))


def view_dependencies_by_substring(views: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges wherever ``dataset.table`` of a table occurs anywhere in a view's lower-cased text.

    Containment runs as two equi joins: at each dot of the text the dataset must end just before it and the
    table start just after it. Only ends and starts of lengths that occur among the names are tried, so a
    text costs its dots times the few distinct dataset lengths, then the lengths of that dataset's tables.
    """
    names = tables.select(
        F.col("table_ref").alias("source"), F.lower("dataset_id").alias("_ds"), F.lower("table_id").alias("_tb")
    ).filter(~F.col("_ds").contains(".") & ~F.col("_tb").contains("."))  # a dot inside a name is no valid name
    datasets = names.groupBy("_ds").agg(F.collect_set(F.length("_tb")).alias("_table_lengths"))
    lengths = names.agg(F.collect_set(F.length("_ds"))).scalar()  # one array of distinct name lengths

    pieces = views.select("view_ref", F.split(F.lower("view_query"), r"\.").alias("_p"))
    dots = F.size("_p") - 1
    sides = F.arrays_zip(F.slice("_p", F.lit(1), dots).alias("_left"), F.slice("_p", F.lit(2), dots).alias("_right"))
    around = pieces.filter(dots > 0).select("view_ref", F.inline(sides))
    ends = around.select("*", F.explode(lengths).alias("_n")).filter(F.length("_left") >= F.col("_n")).select(
        "view_ref", "_right", F.right("_left", F.col("_n")).alias("_ds")
    )
    # one row a dataset: the texts stay in their tasks, where a few datasets would otherwise gather all of them
    starts = ends.join(F.broadcast(datasets), "_ds").select("view_ref", "_ds", "_right", F.explode("_table_lengths").alias("_n")).filter(
        F.length("_right") >= F.col("_n")
    ).select("view_ref", "_ds", F.left("_right", F.col("_n")).alias("_tb"))
    found = starts.join(names, ["_ds", "_tb"]).filter(F.col("source") != F.col("view_ref"))
    return found.select("source", F.col("view_ref").alias("target"), F.lit("view").alias("edge_type")).distinct()


def key_edges(profile: DataFrame, at_least: float = 0.9) -> DataFrame:
    """Which table feeds which, from shared keys: a whole-number column of the same name (but for a one-letter prefix) in both.

    A key's home is the table in which it tells rows apart (at least this share of distinct values, which a sketch may
    miscount a little); of several the one with most rows, then the first by name. The other tables with the key read it.
    """
    keys = profile.filter("data_type IN ('tinyint', 'smallint', 'int', 'bigint')").select(
        "table_id", F.regexp_replace("column_name", "^[A-Za-z]_", "").alias("key"), "total_rows", F.try_divide("distinct_count", "total_rows").alias("share")
    )
    homes = keys.filter(F.col("share") >= at_least).groupBy("key").agg(F.min(F.struct((-F.col("total_rows")).alias("n"), "table_id")).alias("home"))
    found = keys.join(homes.select("key", F.col("home.table_id").alias("source")), "key").filter("table_id <> source")
    return found.select("source", F.col("table_id").alias("target"), F.lit("reference").alias("edge_type")).distinct()


def clean_edges(edges: DataFrame, file_schemes: list[str] = ["gs://", "s3://", "s3a://", "hdfs://", "file:"]) -> DataFrame:
    """Distinct edges with scheme prefixes dropped on both ends; no self links, file targets or report targets.

    An edge that was reported with several types keeps the first of them by name.
    """
    source, target = strip_scheme(F.col("source")), strip_scheme(F.col("target"))
    is_file = reduce(lambda a, b: a | b, [target.startswith(s) for s in file_schemes])
    return (
        edges.select(source.alias("source"), target.alias("target"), "edge_type")
        .filter((F.col("source") != F.col("target")) & ~is_file & ~target.endswith(".md"))
        .groupBy("source", "target")
        .agg(F.min("edge_type").alias("edge_type"))
    )


def links_of(edges: DataFrame, asset: str) -> DataFrame:
    """Direct neighbours of one asset with their direction."""
    up = edges.filter(F.col("target") == asset).select(F.col("source").alias("neighbour"), F.lit("upstream").alias("direction"))
    down = edges.filter(F.col("source") == asset).select(F.col("target").alias("neighbour"), F.lit("downstream").alias("direction"))
    return up.union(down).distinct()


def reach(edges: DataFrame, roots: list[str], direction: str = "downstream", max_depth: int = 3) -> DataFrame:
    """Every node reachable from the roots with its smallest depth, without the roots.

    Breadth first: each round joins the last frontier to the edges, drops known nodes and is written as a
    table in the checkpoint folder. Cycles end by themselves; a round with no new node ends the walk.
    """
    if direction not in ("downstream", "upstream"):
        raise ValueError("direction must be downstream or upstream")
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth must lie between 1 and 10")
    spark = edges.sparkSession
    near, far = ("source", "target") if direction == "downstream" else ("target", "source")
    steps = edges.select(F.col(near).alias("node"), F.col(far).alias("next"))
    frontier = spark.createDataFrame([(r, 0) for r in roots], "node string, depth int")
    seen = frontier
    for depth in range(1, max_depth + 1):
        found = steps.join(frontier.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def reach_from(edges: DataFrame, roots: DataFrame, direction: str = "downstream", max_depth: int = 3, hub: int = HUB) -> DataFrame:
    """``(root, node, depth)`` for every node that a root of the table ``roots`` reaches, with its smallest depth, without the root itself.

    ``roots`` has a column ``root`` and may have ``max_depth`` (1 to 10), the depth of that root; of several rows of a root the deepest
    counts, a null depth is ``max_depth``, a null root is none. All roots walk together: a round joins the frontier to the edges, which
    are dealt by node once. The edges of a node with more than ``hub`` of them are dealt into parts, so no task gets a whole hub.
    """
    if direction not in ("downstream", "upstream"):
        raise ValueError("direction must be downstream or upstream")
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth must lie between 1 and 10")
    near, far = ("source", "target") if direction == "downstream" else ("target", "source")
    limit = F.coalesce(F.col("max_depth").cast("int"), F.lit(max_depth)) if "max_depth" in roots.columns else F.lit(max_depth)
    starts = roots.filter("root IS NOT NULL").groupBy("root").agg(F.max(limit).alias("max_depth"))
    spark, starts = edges.sparkSession, cut_lineage(starts)
    deepest, shallowest = starts.agg(F.max("max_depth"), F.min("max_depth")).first()
    if deepest is not None and not 1 <= shallowest <= deepest <= 10:
        raise ValueError("max_depth must lie between 1 and 10")

    pairs = edges.select(F.col(near).alias("node"), F.col(far).alias("next")).filter("node IS NOT NULL AND next IS NOT NULL")
    degrees = cut_lineage(pairs.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).groupBy((F.col("_n") > hub).alias("_hub"), F.when(F.col("_n") > hub, F.col("node")).alias("node")).agg(F.sum("_n").alias("_n")))
    total = degrees.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # at most one row for every ``hub`` edges
    hubs = degrees.filter("_hub").select("node", F.ceil(F.col("_n") / F.lit(hub)).cast("int").alias("_parts"))
    dealt = pairs.join(F.broadcast(hubs), "node", "left").withColumn("_part", F.pmod(F.xxhash64("next"), F.coalesce("_parts", F.lit(1))).cast("int"))
    # kept on the executors' disks as they are dealt and sorted, so that no round shuffles or sorts the edges again
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // STEPS))
    steps = dealt.select("node", "_part", "next").repartition(ways, "node", "_part").sortWithinPartitions("node", "_part").persist(StorageLevel.DISK_ONLY)
    try:
        frontier = starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), "max_depth")
        seen = frontier
        for depth in range(1, (deepest or 0) + 1):
            going = frontier.filter(F.col("depth") < F.col("max_depth")).join(F.broadcast(hubs), "node", "left")
            parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
            going = going.select("root", "max_depth", "node", F.explode(parts).alias("_part"))
            # an edge may come twice, and a node by several ways; both are dropped where the known nodes are
            found = going.join(steps, ["node", "_part"]).groupBy("root", F.col("next").alias("node")).agg(F.first("max_depth").alias("max_depth"))
            fresh = found.join(seen.select("root", "node"), ["root", "node"], "left_anti")
            frontier = cut_lineage(fresh.select("root", "node", F.lit(depth).alias("depth"), "max_depth"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    finally:
        steps.unpersist()
    return seen.filter("depth > 0").select("root", "node", "depth")


def lineage_graph(edges: DataFrame, root: str, direction: str = "both", max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes (with direction and depth) and edges of the graph around one asset."""
    ways = ["upstream", "downstream"] if direction == "both" else [direction]
    parts = [reach(edges, [root], way, max_depth).withColumn("direction", F.lit(way)) for way in ways]
    start = edges.sparkSession.createDataFrame([(root, 0, "root")], "node string, depth int, direction string")
    nodes = reduce(DataFrame.unionByName, parts, start)
    names = nodes.select("node").distinct()
    inner = edges.join(names.withColumnRenamed("node", "source"), "source", "left_semi").join(
        names.withColumnRenamed("node", "target"), "target", "left_semi"
    )
    return nodes, inner.select("source", "target", "edge_type")


def lineage_totals(nodes: DataFrame) -> DataFrame:
    """Totals per direction and the depth reached."""
    return nodes.agg(
        F.count_if(F.expr("direction = 'upstream'")).alias("total_upstream"),
        F.count_if(F.expr("direction = 'downstream'")).alias("total_downstream"),
        F.max("depth").alias("max_depth_reached"),
    )


def coverage(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """How many tables have sources or consumers, the link totals and the covered share.

    Both ends are counted per table before they meet the table list, so a hub is one row by then.
    """
    ups = edges.groupBy(F.col("target").alias("table_ref")).agg(F.count(F.lit(1)).alias("n_up"))
    downs = edges.groupBy(F.col("source").alias("table_ref")).agg(F.count(F.lit(1)).alias("n_down"))
    per_table = tables.select("table_ref").join(ups, "table_ref", "left").join(downs, "table_ref", "left")
    has_up, has_down = F.col("n_up").isNotNull(), F.col("n_down").isNotNull()
    counted = per_table.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(has_up).alias("tables_with_upstream"),
        F.count_if(has_down).alias("tables_with_downstream"),
        F.count_if(has_up | has_down).alias("tables_with_lineage"),
        F.coalesce(F.sum("n_up"), F.lit(0)).alias("upstream_links"),
        F.coalesce(F.sum("n_down"), F.lit(0)).alias("downstream_links"),
    )
    rate = F.round(F.try_divide(F.col("tables_with_lineage") * F.lit(100.0), F.col("total_tables")), 2)
    return counted.withColumn("coverage_rate", rate)


def job_events(links: DataFrame, process: str, task: str, start: Column, end: Column, succeeded: bool) -> DataFrame:
    """One lineage event per distinct source and target of a job run, ready to append."""
    state = "COMPLETED" if succeeded else "FAILED"
    run_id = F.concat_ws("/", F.lit(process), F.lit(task), F.date_format(utc(start), "yyyyMMdd'T'HHmmss"))
    return links.select("source", "target").distinct().select(
        F.lit(process).alias("process"), run_id.alias("run_id"), F.lit(state).alias("state"),
        start.alias("start_time"), end.alias("end_time"), "source", "target",
    )
