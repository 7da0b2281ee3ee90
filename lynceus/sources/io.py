"""Readers, writers, persisted models, guarded reloads and resumable runs. Schemas are declared, never inferred."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lynceus.operators.derive import flatten_bundle
from lynceus.operators.sampling import config_digest, id_fingerprint, table_digest


class SchemaError(ValueError):
    """A source does not have the declared columns."""


class FingerprintError(ValueError):
    """Persisted rows are not the expected set of ids."""


def _doubles(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names.split()])


#: Fixed column layouts of the two cohorts, in file order.
SITE_SCHEMA = _doubles("age sex cp trestbps chol fbs restecg thalach exang oldpeak slope ca thal num")
LARGE_SCHEMA = T.StructType([
    T.StructField(n, T.DoubleType() if n == "weight" else T.IntegerType() if n == "cardio" else T.LongType())
    for n in "id age gender height weight ap_hi ap_lo cholesterol gluc smoke alco active cardio".split()
])


def read_headerless(spark: SparkSession, path: str | list[str], schema: T.StructType = SITE_SCHEMA, null_token: str = "?") -> DataFrame:
    """Comma-separated rows without a header; ``null_token`` is null, anything unparseable stops the job."""
    return spark.read.schema(schema).option("nullValue", null_token).option("mode", "FAILFAST").csv(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ";", expected: T.StructType = LARGE_SCHEMA) -> DataFrame:
    """Rows under a header; the header must hold exactly the expected set of columns, in any order."""
    as_text = spark.read.option("sep", sep).option("header", True).csv(path)
    want = {f.name: f.dataType for f in expected}
    if set(as_text.columns) != set(want) or len(as_text.columns) != len(want):
        raise SchemaError(f"columns {sorted(as_text.columns)}, expected {sorted(want)}")
    schema = T.StructType([T.StructField(c, want[c]) for c in as_text.columns])
    typed = spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "FAILFAST").csv(path)
    return typed.select(*want)


def read_sites(spark: SparkSession, sites: dict[str, str], schema: T.StructType = SITE_SCHEMA, null_token: str = "?") -> DataFrame:
    """Several site files of one layout, each row tagged with its site."""
    out = None
    for site, path in sites.items():
        part = read_headerless(spark, path, schema, null_token).withColumn("site", F.lit(site))
        out = part if out is None else out.unionByName(part)
    return out


def read_bundles(spark: SparkSession, path: str, as_of_year: int) -> DataFrame:
    """One JSON document per line to flat subject rows; ``source_file`` names where a row came from."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("bundle"))
    return flatten_bundle(lines, "bundle", as_of_year)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("parquet", "json", "orc"):
        getattr(writer, fmt)(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A long-form report as JSON lines."""
    report.write.mode(mode).json(path)


def read_scores(spark: SparkSession, path: str, expected_fp: str, id_col: str = "id") -> DataFrame:
    """Persisted scores, only if their id set is the expected one."""
    df = spark.read.parquet(path)
    found = id_fingerprint(df.select(id_col).distinct(), id_col).first()["fingerprint"]
    if found != expected_fp:
        raise FingerprintError(f"id set {found}, expected {expected_fp}")
    return df


def save_model(model: PipelineModel, path: str, manifest: dict) -> None:
    """The fitted stages and, next to them, one manifest row with its own digest."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/stages")
    body = json.dumps(manifest, sort_keys=True, default=str)
    row = [(body, config_digest(json.loads(body)))]
    spark.createDataFrame(row, "manifest string, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.active()
    row = spark.read.schema("manifest string, digest string").json(f"{path}/manifest").first()
    manifest = json.loads(row["manifest"])
    if config_digest(manifest) != row["digest"]:
        raise SchemaError("the manifest does not match its digest")
    return PipelineModel.load(f"{path}/stages"), manifest


def _exists(spark: SparkSession, path: str) -> bool:
    """A table counts as written only with its success marker: a lost job leaves none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def run_missing(keys: list, path: str, fn: Callable[[object], DataFrame], valid: Callable[[DataFrame], bool] | None = None,
                key: str = "seed") -> DataFrame:
    """Runs ``fn(key)`` for keys without a finished, valid part under ``path``; returns all parts.

    Every part is written by one job and carries a success marker, so a run cut short redoes only its
    unfinished parts. ``valid`` can reject a stale part.
    """
    spark = SparkSession.active()
    parts = []
    for k in keys:
        part = f"{path}/{key}={k}"
        done = _exists(spark, part)
        if done and valid is not None:
            done = valid(spark.read.parquet(part))
        if not done:
            fn(k).write.mode("overwrite").parquet(part)
        parts.append(spark.read.parquet(part).withColumn(key, F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_keys(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return keys.join(done.select(key).distinct(), key, "left_anti")


def cached(df: DataFrame, inputs: list[DataFrame], config: dict, path: str) -> tuple[DataFrame, bool]:
    """A derived table stored under a digest of its inputs' contents and its configuration.

    Returns the stored table and whether it was already there.
    """
    spark = df.sparkSession
    digests = [table_digest(i).first()["digest"] for i in inputs]
    target = f"{path}/{config_digest({'inputs': digests, 'config': config})}"
    hit = _exists(spark, target)
    if not hit:
        df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target), hit


def report_document(sections: dict[str, DataFrame]) -> DataFrame:
    """Differently shaped report parts as one long table ``(section, body json)``."""
    out = None
    for name, df in sections.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


def manifest_of(**parts) -> dict:
    """Plain manifest fields; dataclasses become dictionaries."""
    return {k: asdict(v) if hasattr(v, "__dataclass_fields__") else v for k, v in parts.items()}


def in_unit_interval(c: str) -> Column:
    return F.col(c).between(0.0, 1.0)
