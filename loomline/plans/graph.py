"""Lineage closure: edges, roots, leaves, traces in both directions, and steps from origins to destinations.

A graph is a DataFrame of edges. Traces go level by level; each level is one join of the
frontier with the edges on (file, node), so a lineage never leaves its file. Rows carry no
paths. With `again`, a node is told and followed on every level it is reached on, and only the
steps within a cycle end: each of its nodes is followed once for each level on which the cycle
is entered. Without, a node that has been reached isn't followed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import checkpoint_dir

MAX_DEPTH = 100


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: long loops neither grow the plan nor lose data with an executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


# -- the graph of a mapping table --------------------------------------------------------------


def as_lineage(mapping: DataFrame) -> DataFrame:
    """The mapping table under the names that the graph operators read."""
    return mapping.select("filename", F.col("input_table_name").alias("input_table"), "input_field", "clause", "expression_sql", "output_table", F.col("output_field_alias").alias("output_field"))


def table_edges(lineage: DataFrame) -> DataFrame:
    return lineage.where("input_table is not null and output_table is not null").select("filename", F.col("input_table").alias("source"), F.col("output_table").alias("target")).distinct()


def column_edges(lineage: DataFrame) -> DataFrame:
    full = lineage.where("input_table is not null and input_field is not null and output_table is not null and output_field is not null")
    return full.select("filename", F.col("input_table").alias("source"), F.col("input_field").alias("source_field"), F.col("output_table").alias("target"), F.col("output_field").alias("target_field"), "clause", "expression_sql").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Inputs that nothing makes."""
    made = edges.select("filename", F.col("target").alias("node"))
    return edges.select("filename", F.col("source").alias("node")).distinct().join(made, ["filename", "node"], "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    """Outputs that nothing reads."""
    read = edges.select("filename", F.col("source").alias("node"))
    return edges.select("filename", F.col("target").alias("node")).distinct().join(read, ["filename", "node"], "left_anti")


def root_columns(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Selected input columns of root tables."""
    inputs = columns.where("clause = 'select'").select("filename", F.col("source").alias("node"), F.col("source_field").alias("field")).distinct()
    return inputs.join(roots(tables), ["filename", "node"], "left_semi")


def leaf_columns(columns: DataFrame) -> DataFrame:
    """Selected output columns that no expression reads."""
    read = columns.select("filename", F.col("source").alias("node"), F.col("source_field").alias("field"))
    made = columns.where("clause = 'select'").select("filename", F.col("target").alias("node"), F.col("target_field").alias("field")).distinct()
    return made.join(read, ["filename", "node", "field"], "left_anti")


# -- traces ------------------------------------------------------------------------------------


def _marked(edges: DataFrame) -> DataFrame:
    """edges (filename, s, t, ...) with `turns`: whether the step stays on a cycle."""
    end = lambda c: F.struct("filename", F.col(c).alias("node"))
    round_ = mutual(edges.select(end("s").alias("source"), end("t").alias("target")))
    on = round_.select(F.col("source.filename").alias("filename"), F.col("source.node").alias("s"), F.col("target.node").alias("t"), F.lit(True).alias("_on"))
    return durable(edges.join(on, ["filename", "s", "t"], "left").withColumn("turns", F.coalesce("_on", F.col("s") == F.col("t"))).drop("_on"))


def _turning(edges: DataFrame, again: bool) -> DataFrame:
    return _marked(edges) if again else edges.withColumn("turns", F.lit(False))


def _levels(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], depth: int, again: bool = False) -> DataFrame:
    """All frontiers from `start` on. A frontier keeps the nodes that no earlier one had; with `again`, those that no earlier one had since the cycle they are on was entered.

    step carries `entered`, and gives `turns` with each step.
    """
    columns, since = start.columns, [*key, "entered"] if again else key
    frontier = durable(start.withColumn("entered", F.lit(0)))
    seen, out = frontier.select(*since).distinct(), frontier.select(*columns)
    for level in range(1, depth + 1):
        found = step(frontier).withColumn("level", F.lit(level)).withColumn("entered", F.when(F.col("turns"), F.col("entered")).otherwise(F.lit(level)))
        found = durable(found.select(*columns, "entered").distinct())
        if found.isEmpty():
            return out.distinct() if again else out
        out = out.unionByName(found.select(*columns))
        fresh = found.join(seen, since, "left_anti")
        seen = durable(seen.unionByName(fresh.select(*since).distinct()))
        frontier = fresh
    raise RuntimeError(f"the trace goes deeper than {depth} levels")


def forward_tables(edges: DataFrame, start: DataFrame | None = None, depth: int = MAX_DEPTH, again: bool = False) -> DataFrame:
    """(filename, origin, source, target, level): level 0 is the origin with source ''.

    A step into a table that the trace has reached before is told, and followed again only with `again`.
    """
    first = (roots(edges) if start is None else start).select("filename", F.col("node").alias("origin"), F.lit("").alias("source"), F.col("node").alias("target"), F.lit(0).alias("level"))
    e = _turning(edges.select("filename", F.col("source").alias("s"), F.col("target").alias("t")), again)

    def step(frontier: DataFrame) -> DataFrame:
        f = frontier.select("filename", "origin", F.col("target").alias("s"), "entered").distinct()
        return f.join(e, ["filename", "s"]).select("filename", "origin", F.col("s").alias("source"), F.col("t").alias("target"), "entered", "turns")

    return _levels(first, step, ["filename", "origin", "target"], depth, again)


def backward_tables(edges: DataFrame, start: DataFrame | None = None, depth: int = MAX_DEPTH, again: bool = False) -> DataFrame:
    """(filename, destination, source, target, level): levels go down from 0, the destination itself."""
    first = (leaves(edges) if start is None else start).select("filename", F.col("node").alias("destination"), F.col("node").alias("source"), F.lit("").alias("target"), F.lit(0).alias("level"))
    e = _turning(edges.select("filename", F.col("source").alias("s"), F.col("target").alias("t")), again)

    def step(frontier: DataFrame) -> DataFrame:
        f = frontier.select("filename", "destination", F.col("source").alias("t"), "entered").distinct()
        return f.join(e, ["filename", "t"]).select("filename", "destination", F.col("s").alias("source"), F.col("t").alias("target"), "entered", "turns")

    return _levels(first, step, ["filename", "destination", "source"], depth, again).withColumn("level", -F.col("level"))


def _as_nodes(columns: DataFrame) -> DataFrame:
    """Column edges as edges between (table, field) structs."""
    return columns.select("filename", F.struct(F.col("source").alias("table"), F.col("source_field").alias("field")).alias("source"), F.struct(F.col("target").alias("table"), F.col("target_field").alias("field")).alias("target"), "clause", "expression_sql")


def _start_nodes(start: DataFrame) -> DataFrame:
    return start.select("filename", F.struct(F.col("node").alias("table"), "field").alias("node"))


def _flat(trace: DataFrame, end: str) -> DataFrame:
    cells = [c for side in (end, "source", "target") for c in (F.col(f"{side}.table").alias(side), F.col(f"{side}.field").alias(f"{side}_field"))]
    return trace.select("filename", *cells, "clause", "expression_sql", "level")


def forward_columns(columns: DataFrame, start: DataFrame, depth: int = MAX_DEPTH, again: bool = False) -> DataFrame:
    """As forward_tables, of (table, field), with clause and expression of each step. start: (filename, node, field)."""
    e = _turning(_as_nodes(columns).select("filename", F.col("source").alias("s"), F.col("target").alias("t"), "clause", "expression_sql"), again)
    none = F.struct(F.lit("").alias("table"), F.lit("").alias("field"))
    first = _start_nodes(start).select("filename", F.col("node").alias("origin"), none.alias("source"), F.col("node").alias("target"), F.lit("").alias("clause"), F.lit("").alias("expression_sql"), F.lit(0).alias("level"))

    def step(frontier: DataFrame) -> DataFrame:
        f = frontier.select("filename", "origin", F.col("target").alias("s"), "entered").distinct()
        return f.join(e, ["filename", "s"]).select("filename", "origin", F.col("s").alias("source"), F.col("t").alias("target"), "clause", "expression_sql", "entered", "turns")

    return _flat(_levels(first, step, ["filename", "origin", "target"], depth, again), "origin")


def backward_columns(columns: DataFrame, start: DataFrame, depth: int = MAX_DEPTH, again: bool = False) -> DataFrame:
    """As backward_tables, of (table, field), with clause and expression of each step."""
    e = _turning(_as_nodes(columns).select("filename", F.col("source").alias("s"), F.col("target").alias("t"), "clause", "expression_sql"), again)
    none = F.struct(F.lit("").alias("table"), F.lit("").alias("field"))
    first = _start_nodes(start).select("filename", F.col("node").alias("destination"), F.col("node").alias("source"), none.alias("target"), F.lit("").alias("clause"), F.lit("").alias("expression_sql"), F.lit(0).alias("level"))

    def step(frontier: DataFrame) -> DataFrame:
        f = frontier.select("filename", "destination", F.col("source").alias("t"), "entered").distinct()
        return f.join(e, ["filename", "t"]).select("filename", "destination", F.col("s").alias("source"), F.col("t").alias("target"), "clause", "expression_sql", "entered", "turns")

    out = _levels(first, step, ["filename", "destination", "source"], depth, again).withColumn("level", -F.col("level"))
    return _flat(out, "destination")


# -- steps between origins and destinations ----------------------------------------------------


def _back_within(ends: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """(filename, origin, destination, node, back): how many steps before the destination a node stands, on every way; farthest counts.

    steps: distinct (filename, origin, source, target) of the forward trace.
    """
    start = ends.select("filename", "origin", "destination", F.col("destination").alias("node"), F.lit(0).alias("level"))
    turns = _marked(steps.select("filename", F.col("source").alias("s"), F.col("target").alias("t")).distinct())
    e = durable(steps.select("filename", "origin", F.col("source").alias("s"), F.col("target").alias("t")).join(turns, ["filename", "s", "t"]))

    def step(frontier: DataFrame) -> DataFrame:
        f = frontier.select("filename", "origin", "destination", F.col("node").alias("t"), "entered").distinct()
        return f.join(e, ["filename", "origin", "t"]).select("filename", "origin", "destination", F.col("s").alias("node"), "entered", "turns")

    # a node met again on a longer way is told once more, unless the way runs in a circle
    return _levels(start, step, ["filename", "origin", "destination", "node"], depth, True).withColumnRenamed("level", "back")


def _steps(back: DataFrame, node: list[str]) -> DataFrame:
    """Level 0 is the step farthest from the destination; a node stands at its least level."""
    by = Window.partitionBy("filename", "origin", "destination").orderBy(F.desc("back"))
    ranked = back.withColumn("level", (F.dense_rank().over(by) - 1).cast("int"))
    return ranked.groupBy("filename", "origin", "destination", *node).agg(F.min("level").alias("level"))


def table_lineage(edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(filename, origin, destination, step, level) of every table between a root and a leaf that it reaches."""
    trace = forward_tables(edges, depth=depth)
    ends = trace.select("filename", "origin", F.col("target").alias("node")).distinct().join(leaves(edges), ["filename", "node"]).withColumnRenamed("node", "destination")
    steps = durable(trace.where("source <> ''").select("filename", "origin", "source", "target").distinct())
    back = _back_within(ends.where("origin <> destination"), steps, depth)
    return _steps(back, ["node"]).withColumnRenamed("node", "step")


def column_lineage(columns: DataFrame, tables: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(filename, origin, origin_field, destination, destination_field, step, step_field, level, clause, expression_sql).

    clause and expression are those that make the step; the origin's own are ''.
    """
    trace = forward_columns(columns, root_columns(columns, tables), depth)
    pair = lambda side: F.struct(F.col(side).alias("table"), F.col(f"{side}_field").alias("field"))
    nodes = trace.select("filename", pair("origin").alias("origin"), pair("source").alias("source"), pair("target").alias("target"), "clause", "expression_sql")
    ends = nodes.select("filename", "origin", F.col("target").alias("node")).distinct().join(_start_nodes(leaf_columns(columns)), ["filename", "node"]).withColumnRenamed("node", "destination")
    steps = durable(nodes.where("source.table <> ''").select("filename", "origin", "source", "target").distinct())
    back = _back_within(ends.where("origin <> destination"), steps, depth)
    at = _steps(back, ["node"])
    made = nodes.where("source.table <> ''").groupBy("filename", "origin", F.col("target").alias("node")).agg(F.min(F.struct("clause", "expression_sql")).alias("by"))
    out = at.join(made, ["filename", "origin", "node"], "left")
    cells = [c for side, name in (("origin", "origin"), ("destination", "destination"), ("node", "step")) for c in (F.col(f"{side}.table").alias(name), F.col(f"{side}.field").alias(f"{name}_field"))]
    return out.select("filename", *cells, "level", F.coalesce("by.clause", F.lit("")).alias("clause"), F.coalesce("by.expression_sql", F.lit("")).alias("expression_sql"))


# -- recursive relations -----------------------------------------------------------------------


def mutual(pairs: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """The (source, target) pairs that lie on a cycle: target leads back to source."""
    edges = durable(pairs.where("source <> target").select("source", "target").distinct())
    # nodes that only go in or only come out can't be on a cycle; cutting them leaves the cycles' cores
    while True:
        core = edges.join(edges.select(F.col("source").alias("target")), "target", "left_semi").join(edges.select(F.col("target").alias("source")), "source", "left_semi").select("source", "target").distinct()
        core = durable(core)
        if core.count() == edges.count():
            break
        edges = core
    reach, frontier = edges, edges
    for _ in range(depth):
        found = frontier.select("source", F.col("target").alias("m")).join(edges.select(F.col("source").alias("m"), "target"), "m").select("source", "target").distinct()
        frontier = durable(found.join(reach, ["source", "target"], "left_anti"))
        if frontier.isEmpty():
            back = reach.select(F.col("source").alias("target"), F.col("target").alias("source"))
            return edges.join(back, ["source", "target"], "left_semi")
        reach = durable(reach.unionByName(frontier))
    raise RuntimeError(f"a cycle is longer than {depth} steps")


def versioned_name(name, version):
    return F.when(version != 1, F.format_string("%s [v%d]", name, version)).otherwise(name)


def version_cycles(lineage: DataFrame, order: str = "row_id") -> DataFrame:
    """lineage with `input_table` and `output_table` as versions, so that no file's tables go in circles.

    In each file the pairs of tables that are on a common cycle are taken as they are first
    seen; the last row of the pair makes a new version of its output, and all later rows of
    the file that name this table mean the new version. The fold over a file's rows is
    sequential; a file is one group.
    """
    import pandas as pd

    pairs = mutual(lineage.select(F.col("input_table").alias("source"), F.col("output_table").alias("target")))
    marks = pairs.select(F.col("source").alias("input_table"), F.col("target").alias("output_table"), F.lit(True).alias("_recursive"))
    marked = lineage.join(marks, ["input_table", "output_table"], "left").withColumn("_recursive", F.coalesce("_recursive", F.lit(False))).select(*lineage.columns, "_recursive")
    out_schema = lineage.schema

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        v_in, v_out = [1] * len(rows), [1] * len(rows)
        a, b = rows["input_table"].tolist(), rows["output_table"].tolist()
        done = set()
        for i in range(len(rows)):
            pair = frozenset((a[i], b[i]))
            if not rows["_recursive"][i] or pair in done:
                continue
            done.add(pair)
            last = max(k for k in range(len(rows)) if frozenset((a[k], b[k])) == pair)
            target = b[last]
            v_out[last] += 1
            for k in range(last + 1, len(rows)):
                v_in[k] += a[k] == target
                v_out[k] += b[k] == target
        named = lambda n, v: n if v == 1 or n is None else f"{n} [v{v}]"
        rows["input_table"] = [named(n, v) for n, v in zip(a, v_in, strict=True)]
        rows["output_table"] = [named(n, v) for n, v in zip(b, v_out, strict=True)]
        return rows[out_schema.fieldNames()]

    return marked.groupBy("filename").applyInPandas(fold, out_schema)
