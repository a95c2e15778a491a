"""Documented against modelled columns: comparison, rule checks, summary, change report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.plans.graph import durable

# The report's words.
OK, NOT_MODELLED, NOT_DOCUMENTED = "OK", "No esta modelado", "En QA pero no en DA"
FIXED, PREFIX, UNRULED = "Fijo", "PreFijo", "OBSERVADO"


def state(documented: Column, modelled: Column) -> Column:
    return F.when(documented & modelled, OK).when(documented, NOT_MODELLED).when(modelled, NOT_DOCUMENTED)


def compare(documented: DataFrame, modelled: DataFrame, keys: list[str], state_column: str = "QA_Campo") -> DataFrame:
    """Full outer comparison: one row a matching pair, and one for each side's rest. Null keys match nothing."""
    left, right = documented.withColumn("_da", F.lit(True)), modelled.withColumn("_qa", F.lit(True))
    both = left.join(right, keys, "full")
    out = both.withColumn(state_column, state(F.coalesce("_da", F.lit(False)), F.coalesce("_qa", F.lit(False)))).drop("_da", "_qa")
    extras = [c for c in out.columns if c not in documented.columns]
    return out.select(*documented.columns, *extras)


def all_layers(layers: list[DataFrame]) -> DataFrame:
    """Whichever layers there are, by column name."""
    if not layers:
        raise ValueError("no layer to report on")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def layer_fields(parameters: DataFrame, layer: str, only_checked: bool = False) -> DataFrame:
    """Distinct field names of a layer in the order of their first row (`ROW_ID`)."""
    rows = parameters.where(F.upper("CAPA") == layer.upper())
    if only_checked:
        rows = rows.where(F.upper("VALIDAR") == "SI")
    return ordered_distinct(rows, "NOM_CAMPO_ARCHIVO", "ROW_ID")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, with the place of its first row."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias(order))


def arrival_order(df: DataFrame, order: list[str], name: str = "ORDEN") -> DataFrame:
    """Numbers from 1 in the order of the given source columns.

    A global number needs no global sort in one task: rows are ranged over partitions,
    counted, and numbered within each from where the one before ends.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # ranges are sampled: both reads must see the same
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order)
    return ranged.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(name, (F.col("_before") + F.row_number().over(within)).cast("bigint")).drop("_part", "_p", "_before")


# -- rule checks -------------------------------------------------------------------------------


def observation(actual: Column, expected: Column, warning: Column) -> Column:
    return F.when(actual == expected, OK).otherwise(warning)


def check_fixed(fields: DataFrame, controls: DataFrame, field: str = "CAMPO_FISICO", domain: str = "PARENT_DOMAIN") -> DataFrame:
    """Every field with its guideline, and for fixed controls what the field's domain should be.

    Controls that are equal in all they say count once; a field meets every other control of its
    name in any case, one row each.
    """
    fixed = controls.where(F.col("LINEAMIENTO") == FIXED).select("CONTROL", "PARENT_DOMAIN", "WARNING_PARENT_DOMAIN").distinct()
    c = fixed.select(F.col("CONTROL").alias("C_CONTROL"), F.col("PARENT_DOMAIN").alias("C_DOMAIN"), F.col("WARNING_PARENT_DOMAIN").alias("C_WARNING"))
    out = fields.join(c, F.upper(field) == F.upper("C_CONTROL"), "left")
    out = out.withColumn("LINEAMIENTO", F.when(F.col("C_CONTROL").isNotNull(), FIXED).otherwise(PREFIX)).withColumn("CONTROL", F.col("C_CONTROL"))
    return out.withColumn("Observaciones", F.when(F.col("C_CONTROL").isNotNull(), observation(F.col(domain), F.col("C_DOMAIN"), F.col("C_WARNING")))).drop("C_CONTROL", "C_DOMAIN", "C_WARNING")


def prefix_lengths(controls: DataFrame, most: int = 64) -> list[int]:
    """The lengths that prefixes have: a few numbers, whatever the number of prefixes."""
    rows = controls.where(F.col("LINEAMIENTO") == PREFIX).select(F.length("CONTROL").alias("n")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"prefixes of more than {most} lengths")
    return sorted((r.n for r in rows if r.n), reverse=True)


def check_prefix(fields: DataFrame, controls: DataFrame, field: str = "CAMPO_FISICO", domain: str = "PARENT_DOMAIN") -> DataFrame:
    """Every field with its longest prefix; fields without one are `OBSERVADO`, with no observation.

    One equality join on each length a prefix may have, so that no field meets all prefixes.
    """
    prefixes = controls.where((F.col("LINEAMIENTO") == PREFIX) & (F.length("CONTROL") > 0)).groupBy(F.upper("CONTROL").alias("P")).agg(F.min(F.struct("CONTROL", "PARENT_DOMAIN", "WARNING_PARENT_DOMAIN")).alias("c")).select("P", "c.*")
    p = prefixes.select("P", F.col("CONTROL").alias("P_CONTROL"), F.col("PARENT_DOMAIN").alias("P_DOMAIN"), F.col("WARNING_PARENT_DOMAIN").alias("P_WARNING"))
    lengths = prefix_lengths(controls)
    name = F.upper(F.col(field))
    # each distinct name meets the prefixes of its own heads only; the longest that exists wins
    names = fields.select(name.alias("_name")).where(F.col("_name").isNotNull()).distinct()
    starts = [F.when(F.length("_name") >= n, F.substring("_name", 1, n)) for n in lengths] or [F.lit(None).cast("string")]
    heads = names.withColumn("_head", F.explode(F.array_compact(F.array(*starts))))
    best = heads.join(p, F.col("_head") == F.col("P")).groupBy("_name").agg(F.max_by(F.struct("P_CONTROL", "P_DOMAIN", "P_WARNING"), F.length("P")).alias("_best"))
    out = fields.join(best, name == F.col("_name"), "left")
    found = F.col("_best.P_CONTROL").isNotNull()
    out = out.withColumn("LINEAMIENTO", F.lit(PREFIX)).withColumn("CONTROL", F.when(found, F.upper(F.col("_best.P_CONTROL"))).otherwise(UNRULED))
    return out.withColumn("Observaciones", F.when(found, observation(F.col(domain), F.col("_best.P_DOMAIN"), F.col("_best.P_WARNING")))).drop("_name", "_best")


def check_domains(fields: DataFrame, controls: DataFrame, field: str = "CAMPO_FISICO", domain: str = "PARENT_DOMAIN") -> DataFrame:
    """Fixed controls where they apply, the longest prefix elsewhere."""
    fixed = check_fixed(fields, controls, field, domain)
    rest = fixed.where(F.col("LINEAMIENTO") == PREFIX).drop("LINEAMIENTO", "CONTROL", "Observaciones")
    return fixed.where(F.col("LINEAMIENTO") == FIXED).unionByName(check_prefix(rest, controls, field, domain))


def in_order(df: DataFrame, column: str = "ORDEN_FISICO", table: str = "TABLA_FISICA") -> DataFrame:
    """Rows with an order, as a number where it is one, by table and order."""
    return df.where(F.col(column).isNotNull()).withColumn(column, F.expr(f"try_cast(trim(`{column}`) as int)")).orderBy(table, F.col(column).asc_nulls_last())


# -- summary and changes -----------------------------------------------------------------------


def _tall(one: DataFrame, cells: list[tuple[int, str, str, Column, Column | None]]) -> DataFrame:
    """(n, Categoría, Métrica, Valor) rows of a one-row aggregate; a cell with a condition only where it holds."""
    made = [F.struct(F.lit(n).alias("n"), F.lit(a).alias("Categoría"), F.lit(b).alias("Métrica"), v.cast("string").alias("Valor")) for n, a, b, v, _ in cells]
    made = [m if when is None else F.when(when, m) for m, (*_, when) in zip(made, cells, strict=True)]
    return one.select(F.inline(F.array_compact(F.array(*made))))


def summary(report: DataFrame, checks: DataFrame | None = None, state_column: str = "QA_Campo", extra: dict[str, int] | None = None) -> DataFrame:
    """(Categoría, Métrica, Valor) rows out of one aggregation of each table."""
    count_of = lambda v: F.count_if(F.col(state_column) == v)
    one = report.agg(F.count("*").alias("total"), count_of(OK).alias("ok"), count_of(NOT_MODELLED).alias("missing"), count_of(NOT_DOCUMENTED).alias("surplus"))
    share = F.concat(F.format_string("%.2f", F.when(F.col("total") > 0, 100.0 * F.col("ok") / F.col("total")).otherwise(F.lit(0.0))), F.lit("%"))
    cells = [
        (0, "General", "Total", F.col("total"), None), (1, "Estado", OK, F.col("ok"), None), (2, "Estado", NOT_MODELLED, F.col("missing"), None),
        (3, "Estado", NOT_DOCUMENTED, F.col("surplus"), None), (4, "General", "Cobertura", share, None),
        (100, "Recomendación", "Modelar los campos documentados que faltan", F.col("missing"), F.col("missing") > 0),
        (101, "Recomendación", "Documentar los campos que solo estan en el modelo", F.col("surplus"), F.col("surplus") > 0),
    ]
    cells += [(50 + i, "IA", k, F.lit(v), None) for i, (k, v) in enumerate((extra or {}).items())]
    out = _tall(one, cells)
    if checks is not None:
        seen = F.col("Observaciones")
        pd = checks.agg(F.count("*").alias("total"), F.count_if(seen == OK).alias("ok"), F.count_if(seen != OK).alias("wrong"), F.count_if(seen.isNull()).alias("none"))
        out = out.unionByName(_tall(pd, [
            (10, "Parent domain", "Total", F.col("total"), None), (11, "Parent domain", OK, F.col("ok"), None), (12, "Parent domain", "Con observaciones", F.col("wrong"), None),
            (13, "Parent domain", "Sin control", F.col("none"), None), (102, "Recomendación", "Corregir los dominios observados", F.col("wrong"), F.col("wrong") > 0),
        ]))
    return out.orderBy("n").drop("n")


def changes(before: DataFrame, now: DataFrame, keys: list[str], state_column: str = "QA_Campo", shown: int = 10) -> DataFrame:
    """(Tipo, Cantidad, Detalle): issues that are new, resolved and persistent, with the first names of each."""
    name = F.concat_ws(".", *keys).alias("name")
    issues = lambda df, flag: df.where(F.col(state_column) != OK).select(name).distinct().withColumn(flag, F.lit(True))
    both = issues(before, "was").join(issues(now, "is"), "name", "full")
    kind = F.when(F.col("was").isNull(), "Nuevo").when(F.col("is").isNull(), "Resuelto").otherwise("Persistente")
    kinds = both.select("name", kind.alias("Tipo"))
    # the first names by order without gathering all of them: each partition keeps its first
    ranked = kinds.withColumn("r", F.row_number().over(Window.partitionBy("Tipo", F.pmod(F.xxhash64("name"), F.lit(64))).orderBy("name"))).where(F.col("r") <= shown)
    heads = ranked.groupBy("Tipo").agg(F.slice(F.array_sort(F.collect_list("name")), 1, shown).alias("heads"))
    counts = kinds.groupBy("Tipo").agg(F.count("*").alias("Cantidad"))
    every = before.sparkSession.createDataFrame([(t, i) for i, t in enumerate(("Nuevo", "Resuelto", "Persistente"))], "Tipo string, n int")
    out = every.join(counts, "Tipo", "left").join(heads, "Tipo", "left")
    detail = F.concat(F.array_join(F.coalesce("heads", F.array().cast("array<string>")), ", "), F.when(F.coalesce("Cantidad", F.lit(0)) > shown, "...").otherwise(""))
    return out.orderBy("n").select("Tipo", F.coalesce("Cantidad", F.lit(0)).cast("bigint").alias("Cantidad"), detail.alias("Detalle"))


def new_issues(before: DataFrame, now: DataFrame) -> DataFrame:
    return now.subtract(before)


def persistent_issues(before: DataFrame, now: DataFrame) -> DataFrame:
    return now.intersect(before)
