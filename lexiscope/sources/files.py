"""File sources and sinks: JSON lines, CSV, answer files,
partitioned corpora, evaluation reports, feature caches and fitted models.

Every reader takes an explicit schema - nothing is inferred. Scratch output
goes below the cluster's shared ``spark.checkpoint.dir`` (see
``lexiscope.session.ensure_checkpoint_dir``), never to a machine-local folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORPUS_SCHEMA = "id BIGINT, text STRING, label INT, genre STRING, model STRING"
CORPUS_CSV_SCHEMA = "_c0 BIGINT, id BIGINT, text STRING, label INT, genre STRING, model STRING"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint directory."""
    from lexiscope.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


# A1
def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line. Malformed lines keep their text in
    ``_corrupt_record`` when that column is part of the schema."""
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


# A2
def read_csv(spark: SparkSession, path: str, schema: StructType | str, index_col: str | None = "_c0") -> DataFrame:
    """CSV with header, quoted multi-line fields. Files written with a row
    index carry an extra first column, dropped here."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').csv(path))
    return df.drop(index_col) if index_col and index_col in df.columns else df


# A6
def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, index: bool = False) -> None:
    """CSV with header; ``index`` adds a leading row-number column as a
    pandas export would (only for round-trips of such files)."""
    if index:
        df = df.select(F.monotonically_increasing_id().alias("_c0"), *df.columns)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# A5
def load_answers(spark: SparkSession, path: str, facets=("source", "model", "genre")) -> DataFrame:
    """Answer / truth file -> ``(id STRING, label DOUBLE, *facets)``.

    Rules: blank lines are skipped; a line without ``label`` is an error; a
    two-element list label ``[a, b]`` must have exactly one true value and
    gives ``0.0`` if ``a`` else ``1.0``; a number gives itself; anything else
    (JSON true/false, strings such as "0.7") is an error; when an id repeats
    the last line wins. Types are told apart with VARIANT, since a string
    schema would read 0.7 and "0.7" alike. Errors stop the job through
    ``raise_error``; the last-wins order is (file, block, read order).
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_o"))
    lines = lines.where(F.trim(F.col("value")) != "")
    v = lines.select("_f", "_b", "_o", F.expr("try_parse_json(value)").alias("v"), "value")
    lab = F.expr("variant_get(v, '$.label')")
    typ = F.expr("schema_of_variant(variant_get(v, '$.label'))")
    a = F.expr("variant_get(v, '$.label[0]', 'boolean')")
    b = F.expr("variant_get(v, '$.label[1]', 'boolean')")
    is_num = typ.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | typ.startswith("DECIMAL")
    is_pair = (typ == "ARRAY<BOOLEAN>") & (F.expr("array_size(variant_get(v, '$.label', 'array<boolean>'))") == 2)
    label = (F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("Invalid JSON line: "), F.col("value"))))
             .when(lab.isNull(), F.raise_error(F.lit("Invalid input JSON schema")))
             .when(is_num, F.expr("variant_get(v, '$.label', 'double')"))
             .when(is_pair & (a != b), F.when(a, F.lit(0.0)).otherwise(F.lit(1.0)))
             .when(is_pair, F.raise_error(F.concat(F.lit("Label list needs exactly one true value: "), F.col("value"))))
             .otherwise(F.raise_error(F.concat(F.lit("Invalid label type "), typ, F.lit(" in "), F.col("value")))))
    cols = [F.expr("variant_get(v, '$.id', 'string')").alias("id"), label.alias("label")]
    cols += [F.expr(f"variant_get(v, '$.{f}', 'string')").alias(f) for f in facets]
    rows = v.select(*cols, F.struct("_f", "_b", "_o").alias("_ord"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("label", *facets), F.col("_ord")).alias("r"))
    return last.select("id", "r.*")


# A7
def write_partitions(df: DataFrame, path: str, split: str = "split") -> None:
    """One dataset partitioned by split (instead of one file per split)."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# A8
def write_predictions(df: DataFrame, path: str) -> None:
    """``(id, label)`` CSV keyed by the real id."""
    df.select("id", "label").write.mode("overwrite").option("header", True).csv(path)


# A9
# Report keys of the evaluation JSON (fixed values).
REPORT_KEYS = [("roc_auc", "roc-auc"), ("brier", "brier"), ("c_at_1", "c@1"), ("f1", "f1"),
               ("f05u", "f05u"), ("mean_score", "mean")]


def evaluation_json(result: DataFrame) -> DataFrame:
    """One JSON document per evaluation: the overall metrics and confusion at
    the top level plus one ``_eval-<facet>`` object per facet mapping each
    value to its metrics - built with ``to_json`` on the cluster (the
    per-facet maps hold one entry per facet value)."""
    rec = F.struct(*[F.col(c).alias(k) for c, k in REPORT_KEYS],
                   F.array(F.array("conf_00", "conf_01"), F.array("conf_10", "conf_11")).alias("confusion"))
    per = result.where(F.col("facet") != "all").groupBy("facet").agg(
        F.map_from_entries(F.collect_list(F.struct("value", rec))).alias("m"))
    facets = per.agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat(F.lit("_eval-"), F.col("facet")), "m"))).alias("f"))
    keep_nulls = {"ignoreNullFields": "false"}  # null metrics stay in the report
    overall = result.where(F.col("facet") == "all").select(F.to_json(rec, keep_nulls).alias("o"))
    j = overall.crossJoin(facets).select("o", F.to_json("f", keep_nulls).alias("f"))
    merged = F.when(F.col("f").isNull() | (F.col("f") == "{}"), F.col("o")).otherwise(
        F.concat(F.expr("substring(o, 1, length(o) - 1)"), F.lit(","), F.expr("substring(f, 2)")))
    return j.select(merged.alias("json"))


def evaluation_flat(result: DataFrame) -> DataFrame:
    """The flat ``(key, value)`` dump of the overall metrics: numbers only,
    nulls and the confusion matrix left out."""
    metrics = ["roc_auc", "brier", "c_at_1", "f1", "f05u", "mean_score"]
    o = result.where(F.col("facet") == "all")
    args = ", ".join(f"'{m}', {m}" for m in metrics)
    return o.selectExpr(f"stack({len(metrics)}, {args}) AS (key, value)").where("value IS NOT NULL")


def write_evaluation(result: DataFrame, path: str) -> None:
    """JSON report and flat dump. The result (one row per facet value) is
    materialised once so the two writes do not evaluate twice."""
    from lexiscope.session import checkpointed
    result = checkpointed(result)
    evaluation_json(result).coalesce(1).write.mode("overwrite").text(os.path.join(path, "json"))
    evaluation_flat(result).coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(path, "flat"))


# A10
def save_features(path: str, **tables: DataFrame) -> None:
    """Persist graph tables / features as parquet under ``path/<name>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def load_features(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(path, n)) for n in names}


# A11
def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


# A12
def pairs_to_rows(df: DataFrame) -> DataFrame:
    """``(id, text1, text2, label_txt1, label_txt2)`` -> two rows ``(id, text, label)``."""
    pair = F.array(F.struct(F.col("text1").alias("text"), F.col("label_txt1").alias("label")),
                   F.struct(F.col("text2").alias("text"), F.col("label_txt2").alias("label")))
    return df.select("id", F.explode(pair).alias("r")).select("id", "r.text", "r.label")


# A13
def drop_null_text(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["text"])
