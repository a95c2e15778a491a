"""Hints for the reconciliation: similar names, spelling, domains by example, recurrent errors."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DUPLICATE, SIMILAR = "Posible Duplicado", "Similar"
PROBABILITY = 0.95
#: Rows that a forest needs at least.
LEAST_ROWS = 10
#: Rows that are measured against as many others in one task.
BLOCK_ROWS = 2048


def similar_pairs(names: DataFrame, id_col: str, vector_col: str, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity) of pairs a < b above the threshold, and what they are called.

    Every pair is measured, as the definition asks for, in blocks of rows against blocks of
    rows. Vectors that are null, zero or hold nulls are in no pair.
    """
    return _named(_all_pairs(names, id_col, vector_col, threshold))


def _all_pairs(names: DataFrame, id_col: str, vector_col: str, threshold: float) -> DataFrame:
    v = F.col("v")
    own = names.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0))
    parts = max(1, -(-own.count() // BLOCK_ROWS))
    own = own.withColumns({"k": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "dim": F.size("v")})
    sent = own.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("dim", F.least("k", "to").alias("i"), F.greatest("k", "to").alias("j"), "k", "id", "v")
    kind = names.schema[id_col].dataType.simpleString()

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        dim, i, j = (x.as_py() for x in key)
        ids, k = rows.column("id").to_numpy(), rows.column("k").to_numpy()
        x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
        a, b = np.nonzero(x[left] @ x[right].T > threshold - 1e-9)
        a, b = left[a], right[b]
        measured = (x[a] * x[b]).sum(1)
        turned = (ids[a] > ids[b]) & (i != j)  # within a block each pair is met both ways
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        keep = (measured > threshold) & (ids[a] < ids[b])
        return pa.table({"a": rows.column("id").take(pa.array(a[keep])), "b": rows.column("id").take(pa.array(b[keep])), "similarity": measured[keep]})

    return sent.groupBy("dim", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}, similarity double")


def _named(out: DataFrame) -> DataFrame:
    twin = F.col("similarity") > PROBABILITY
    return out.select("a", "b", "similarity", F.when(twin, DUPLICATE).otherwise(SIMILAR).alias("kind"), F.when(twin, "Alta").otherwise("Media").alias("confidence"), F.round(100 * F.col("similarity"), 1).alias("percent"))


def name_vectors(names: DataFrame, column: str, features: int = 256, n: int = 3) -> DataFrame:
    """Hashed counts of character n-grams, where no embedding is given."""
    text = F.concat(F.lit("^"), F.lower(F.col(column)), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(text, i, n)), F.lit(features)))
    return names.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double")))


def close_names(names: DataFrame, column: str, known: DataFrame, known_column: str, cutoff: float = 0.7, most: int = 3) -> DataFrame:
    """(name, suggestion, ratio, place): the closest known names by sequence ratio. The known names are a dictionary and are broadcast, in at most 100,000 rows."""
    words = [r[0] for r in known.select(known_column).where(F.col(known_column).isNotNull()).distinct().orderBy(known_column).limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("more than 100,000 known names")

    def run(batches):
        for batch in batches:
            rows = []
            for name in batch[column]:
                close = [] if name is None else difflib.get_close_matches(name, words, n=most, cutoff=cutoff)
                rows += [(name, w, round(difflib.SequenceMatcher(None, w, name).ratio(), 6), k + 1, "Alta" if len(close) == 1 else "Media") for k, w in enumerate(close)]
            yield pd.DataFrame(rows, columns=["name", "suggestion", "ratio", "place", "confidence"])

    return names.select(column).distinct().mapInPandas(run, "name string, suggestion string, ratio double, place int, confidence string")


def close_by_edits(names: DataFrame, column: str, known: DataFrame, known_column: str, cutoff: float = 0.7, most: int = 3) -> DataFrame:
    """The same by edit distance, with built-in functions, between all names whose lengths allow the ratio."""
    a = names.select(F.col(column).alias("name")).distinct()
    b = known.select(F.col(known_column).alias("suggestion")).distinct()
    size = [F.length("name"), F.length("suggestion")]
    on = F.least(*size) >= (cutoff - 1e-6) * F.greatest(*size)
    ratio = 1 - F.levenshtein("name", "suggestion") / F.greatest(F.length("name"), F.length("suggestion"))
    out = a.join(b, on).where("name <> suggestion").withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= cutoff)
    w = Window.partitionBy("name").orderBy(F.desc("ratio"), "suggestion")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("name", "suggestion", "ratio", "place")


def train_domains(rows: DataFrame, text_columns: list[str], label: str, trees: int = 100, seed: int = 42, features: int = 100) -> tuple[PipelineModel | None, float | None]:
    """A forest over the words and word pairs of the names, and its accuracy on a fifth held out by label."""
    known = rows.where(F.col(label).isNotNull() & (F.trim(F.col(label)) != "")).withColumn("text", F.concat_ws(" ", *[F.regexp_replace(F.col(c), "_", " ") for c in text_columns]))
    if known.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return None, None
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), "text"), "text")
    split = known.withColumn("_n", F.row_number().over(order) - 1)
    train, test = split.where("_n % 5 <> 4").drop("_n"), split.where("_n % 5 = 4").drop("_n")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=features), IDF(inputCol="counts", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep"),
        RandomForestClassifier(labelCol="label_index", featuresCol="features", numTrees=trees, seed=seed),
    ]
    model = Pipeline(stages=stages).fit(train)
    named = PipelineModel([*model.stages, IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[-2].labels)])
    tested = named.transform(test).agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    return named, tested


def suggest_domains(rows: DataFrame, model: PipelineModel | None, text_columns: list[str], label: str, most: int = 3) -> DataFrame:
    """rows with `suggested`, `probability` and `alternatives`; `N/A` without a model."""
    if model is None:
        return rows.withColumns({"suggested": F.lit("N/A"), "probability": F.lit(0.0), "alternatives": F.array().cast("array<string>")})
    labels = F.array(*[F.lit(x) for x in model.stages[-3].labels])
    keep = rows.withColumn("text", F.concat_ws(" ", *[F.regexp_replace(F.col(c), "_", " ") for c in text_columns]))
    done = model.transform(keep.withColumn(label, F.coalesce(F.col(label), F.lit(""))))
    ranked = F.slice(F.sort_array(F.zip_with(vector_to_array("probability"), labels, lambda p, x: F.struct(p.alias("p"), x.alias("name"))), asc=False), 1, most)
    done = done.withColumn("_ranked", ranked)
    return done.select(*rows.columns, F.col("_ranked")[0]["name"].alias("suggested"), F.round(F.col("_ranked")[0]["p"], 4).alias("probability"), F.transform(F.slice("_ranked", 2, most - 1), lambda s: s["name"]).alias("alternatives"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def observed(rows: DataFrame) -> DataFrame:
    """Rows whose observation isn't OK; none at all counts as not OK."""
    return rows.where(~F.col("Observaciones").eqNullSafe("OK"))


def error_patterns(rows: DataFrame, field: str, kind: str, order: str, least: int = 3) -> DataFrame:
    """(field, kind, n, suggestion): of each field's kinds that occur `least` times the one whose first row comes last."""
    counted = rows.groupBy(F.col(field).alias("field"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.min(order).alias("first")).where(F.col("n") >= least)
    best = counted.groupBy("field").agg(F.max_by(F.struct("kind", "n"), F.struct("first", "kind")).alias("b"))
    advice = F.when(F.col("b.kind") == "No esta modelado", "Agregar al modelo").when(F.col("b.kind") == "En QA pero no en DA", "Agregar al documento").otherwise("Revisar")
    return best.select("field", F.col("b.kind").alias("kind"), F.col("b.n").alias("n"), advice.alias("suggestion"))
