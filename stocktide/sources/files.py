"""Reading and writing datasets as CSV, JSON and parquet; catalog and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide import schemas
from stocktide.functions.scalars import parse_date, to_number
from stocktide.operators.frames import over, rows_of, string_columns
from stocktide.operators.quality import column_profile, date_span, describe
from stocktide.operators.ranks import value_counts


def clean_names(df: DataFrame) -> DataFrame:
    """Trim header names and drop a byte-order mark."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, kind: str | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header. All cells arrive as text; nothing is inferred.

    With `kind` the known columns are typed: dates in the stated format, numbers
    by lenient cast. Column order in the file does not matter.
    """
    df = clean_names(spark.read.csv(path, header=True))
    if kind is None:
        return df
    typed = {}
    for field in schemas.TABLES[kind].fields:
        if field.name in df.columns:
            c = F.col(field.name)
            if isinstance(field.dataType, T.DateType):
                typed[field.name] = parse_date(c, date_format)
            elif isinstance(field.dataType, T.DoubleType):
                typed[field.name] = to_number(c)
    return df.withColumns(typed)


def save_dataset(df: DataFrame, root: str, kind: str, fmt: str = "json") -> None:
    """Write a period-tagged dataset; one folder per period, dates as yyyy-MM-dd."""
    out = df.withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))
    out.write.mode("overwrite").partitionBy("period").format(fmt).save(f"{root}/{kind}")


def save_all(spark: SparkSession, datasets: dict[str, DataFrame | None], root: str) -> DataFrame:
    """Save what is given; status of every expected dataset."""
    status = []
    for kind in schemas.TABLES:
        df = datasets.get(kind)
        if df is not None:
            save_dataset(df, root, kind)
        status += [(p, kind, df is not None) for p in schemas.PERIODS]
    expected = rows_of(spark, status, "period string, type string, given boolean")
    written = catalog(spark, root).select("period", "type", F.col("row_count"))
    out = expected.join(written, ["period", "type"], "left")
    return out.select("period", "type", (F.col("given") & (F.col("row_count") > 0)).alias("saved"))


def load_dataset(spark: SparkSession, root: str, kind: str, period: str | None = None, fmt: str = "json") -> DataFrame | None:
    """A saved dataset, or None when there is none; the period prunes folders."""
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "Date" else f.dataType) for f in schemas.TABLES[kind]])
    schema.add("period", T.StringType())
    try:
        df = spark.read.schema(schema).format(fmt).load(f"{root}/{kind}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if period is not None:
        df = df.where(F.col("period") == period)
    return df.withColumn("Date", F.to_date("Date"))


def load_json_array(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A file holding one JSON array of records (the exchange form of small files)."""
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "Date" else f.dataType) for f in schemas.TABLES[kind]])
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("Date", F.to_date("Date"))


def catalog(spark: SparkSession, root: str, fmt: str = "json") -> DataFrame:
    """Saved datasets: period, type, files, bytes and rows."""
    out = None
    for kind in schemas.TABLES:
        try:
            files = spark.read.schema("period string").format(fmt).load(f"{root}/{kind}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        per_file = files.groupBy("period", F.col("_metadata.file_path").alias("_path")).agg(
            F.max("_metadata.file_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        one = per_file.groupBy("period").agg(
            F.count(F.lit(1)).alias("files"), F.sum("_bytes").alias("size_bytes"), F.sum("_rows").alias("row_count"))
        one = one.withColumn("type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows_of(spark, [], "period string, files bigint, size_bytes bigint, row_count bigint, type string")
    return out


def combined(datasets: dict[str, DataFrame]) -> DataFrame:
    """All datasets stacked over the union of their columns, tagged by name."""
    out = None
    for name, df in datasets.items():
        tagged = df.withColumn("Dataset_Source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def dataset_summary(datasets: dict[str, DataFrame]) -> DataFrame:
    """Per dataset: rows, columns, date range and missing cells."""
    out = None
    for name, df in datasets.items():
        missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
        one = df.agg(
            F.count(F.lit(1)).alias("rows"), F.min("Date").alias("start"), F.max("Date").alias("end"),
            missing.alias("missing_values"),
        ).select(F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"),
                 F.concat_ws(" to ", F.col("start").cast("string"), F.col("end").cast("string")).alias("date_range"), "missing_values")
        out = one if out is None else out.unionByName(one)
    return out


def export_each(datasets: dict[str, DataFrame], root: str) -> DataFrame:
    """One CSV folder per dataset plus the summary; returns the summary."""
    for name, df in datasets.items():
        export_csv(df, f"{root}/{name}")
    summary = dataset_summary(datasets)
    export_csv(summary, f"{root}/summary")
    return summary


def forecasts_with_metrics(forecasts: DataFrame, metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast rows of all models with their error metrics as columns."""
    upper = [F.col(m).alias(m.upper()) for m in ("rmse", "mae", "mape")]
    return forecasts.join(metrics.select(*keys, "model", *upper), [*keys, "model"], "left")


def profile_json(df: DataFrame, name: str, top: int = 10) -> DataFrame:
    """One JSON document per section: describe, missing, range, leading labels.

    Sections are built from aggregates: one entry per column or leading label.
    """
    stats = describe(df).select(F.col("column"), F.to_json(F.struct("count", "mean", "std", "min", "p25", "p50", "p75", "max")).alias("body"))
    missing = column_profile(df).select("column", F.col("missing").cast("string").alias("body"))
    span = date_span(df).select(F.lit("Date").alias("column"), F.to_json(F.struct("start", "end", "total_days")).alias("body"))
    strings = string_columns(df)
    long = df.select(*strings).unpivot([], strings, "column", "label")
    counts = value_counts(long, "label", ["column"]).withColumn(
        "_r", F.row_number().over(over(["column"], F.desc("n"), "label"))).where(F.col("_r") <= top)
    pairs = F.array_sort(F.collect_list(F.struct("_r", "label", "n")))
    labels = counts.groupBy("column").agg(
        F.to_json(F.transform(pairs, lambda p: F.struct(p["label"].alias("label"), p["n"].alias("n")))).alias("body"))
    parts = [(stats, "descriptive_stats"), (missing, "missing_values"), (span, "date_range"), (labels, "categorical_distribution")]
    out = None
    for part, section in parts:
        one = part.select(F.lit(name).alias("dataset"), F.lit(section).alias("section"), "column", "body")
        out = one if out is None else out.unionByName(one)
    return out


def export_metadata(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and range of each dataset as one JSON text per dataset."""
    body = F.to_json(F.struct("rows", "columns", "date_range"))
    return dataset_summary(datasets).select("dataset", body.alias("metadata"))


def comparison_rows(compared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Actual against predicted, measures half-even rounded to two places."""
    names = ["Actual", "Predicted", "Error", "Absolute_Error", "Percentage_Error"]
    return compared.select(*keys, F.date_format("ds", "yyyy-MM-dd").alias("Date"), *[F.bround(n, 2).alias(n) for n in names])


def export_bundle(tables: dict[str, DataFrame], root: str, chosen: Sequence[str]) -> DataFrame:
    """Write the chosen result tables below one run folder; lists what was written."""
    spark = next(iter(tables.values())).sparkSession
    done = None
    for name in chosen:
        if name not in tables:
            continue
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}")
        one = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        done = one if done is None else done.unionByName(one)
    return done if done is not None else rows_of(spark, [], "table string, rows bigint")
