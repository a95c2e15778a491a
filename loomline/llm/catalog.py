"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import ann, bpe, decontam, html_main, license_scan, near_dup, passage_chain, suffix_dedup, toxicity, transcripts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its passages and the least documents of the texts that it shares them with; what passages with a third text prove isn't told again."""
    found = passage_chain.passages(_table(spark, sf_dir, "documents"), all_meet=8, every_copy=False)
    return found.select("doc_id", "n_repeated", "n_passages", F.array_sort(F.array_distinct(F.col("passages.other"))).alias("others"), "passages")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from the role column; the turns' roles are recovered without it."""
    talks = _table(spark, sf_dir, "conversations")
    return transcripts.parse(talks, transcripts.fit(talks), role_marks=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_passages": op6_passages,
    "op7_main_text": op7_main_text,
    "op8_license_scan": op8_license_scan,
    "op9_neighbours": op9_neighbours,
    "op10_chat_turns": op10_chat_turns,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_TEMPLATES = ", ".join(
    f"({n}, {n < len(license_scan.PHRASES)}, '{label}', {len(phrase.split()) - 1}, {t}, '{a}', '{b}')".replace("True", "true").replace("False", "false")
    for n, (phrase, label) in enumerate([*license_scan.PHRASES.items(), *license_scan.NOTICES.items()])
    for t, (a, b) in enumerate(zip(phrase.split(), phrase.split()[1:], strict=False))
)

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
bytes AS (SELECT doc_id, x, len(x) // 2 AS n FROM d),
win AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS p FROM bytes WHERE n >= 50)),
least AS (SELECT w, min(doc_id) AS m FROM win GROUP BY w HAVING count(*) > 1),
cover AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM win JOIN least USING (w) WHERE m < doc_id),
runs AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN prev IS NULL OR prev < p - 1 THEN 1 ELSE 0 END) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM cover) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2), '' ORDER BY p) AS k FROM (SELECT doc_id, x, unnest(range(0, n)) AS p FROM bytes) b ANTI JOIN cover USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM bytes LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_license_scan": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pair AS (SELECT doc_id, i, w[i + 1] AS x, w[i + 2] AS y FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS i FROM d WHERE len(w) > 1)),
t(template, base, label, pairs, t, a, b) AS (VALUES {_TEMPLATES}),
hits AS (SELECT doc_id, template, base, label, pairs, i, t, i - t AS diagonal FROM pair JOIN t ON x = a AND y = b),
step AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, i) AS gap FROM hits),
band AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > CASE WHEN base THEN 0 ELSE 2 END THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal, i) AS n FROM step),
told AS (SELECT *, max(t) OVER (PARTITION BY doc_id, template, n ORDER BY i, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM band),
span AS (SELECT doc_id, template, base, label, pairs, n, min(i) AS first, count(*) FILTER (before IS NULL OR t > before) AS found FROM told GROUP BY ALL),
fit AS (SELECT *, found / pairs AS share FROM span WHERE CASE WHEN base THEN found = pairs ELSE found / pairs >= 0.85 END),
doc AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, max(share) AS score,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM fit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN doc USING (doc_id)""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
b1 AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b1)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, g.n, item_id FROM grams g JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
