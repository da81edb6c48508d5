"""File sources and sinks: CSV tables, JSON-lines log, JSON reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round_exact
from ..schemas import AUDIT, BOOLEAN, MESSAGE, PROFILE


def read_profiles(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, fmt, PROFILE)


def read_messages(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, fmt, MESSAGE)


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Columns of a CSV file go by its header, in any order, and quoted texts may hold line breaks,
    which means that a file is read by one task: use parquet, or many files, for size. A row that
    does not fit the schema fails the read. In a CSV file a missing column is an error.
    """
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    options = dict(header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    names = spark.read.csv(path, **options).columns
    kinds = {f.name: f.dataType for f in schema.fields}
    ordered = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    rows = spark.read.schema(ordered).csv(path, enforceSchema=False, mode="FAILFAST", **options)
    return rows.select(*[f.name for f in schema.fields])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files that ``_read`` gives back unchanged; blanks at the ends of texts included."""
    rows.write.csv(path, header=True, quote='"', escape='"', encoding="UTF-8",
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def booleans_as_ints(profile: DataFrame, columns: list[str] = BOOLEAN) -> DataFrame:
    return profile.withColumns({c: F.col(c).cast("int") for c in columns})


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The log with the superset schema; blank lines are skipped, a missing log is empty."""
    try:
        return spark.read.schema(AUDIT).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AUDIT)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines. Each call adds files; nothing is rewritten."""
    rows.write.mode("append").json(path)


def event_rows(df: DataFrame, step: Column, actor: Column, summary: Column,
               timestamp: Column, status: Column | None = None,
               confidence: Column | None = None,
               extras: dict[str, Column] | None = None) -> DataFrame:
    """Event rows for the log. Extra fields that are log columns stay columns, others go to the
    ``extras`` map as text."""
    extras = extras or {}
    named = {f.name for f in AUDIT.fields}
    fields = {"timestamp": timestamp, "type": F.lit("event"), "step": step, "actor": actor,
              "summary": summary, "status": F.lit("ok") if status is None else status,
              **{n: e for n, e in extras.items() if n in named}}
    if confidence is not None:
        fields["confidence"] = round_exact(confidence, 3)
    loose = {n: e for n, e in extras.items() if n not in named}
    if loose:
        fields["extras"] = F.map_from_entries(F.array(*[
            F.struct(F.lit(n).alias("key"), e.cast("string").alias("value"))
            for n, e in loose.items()]))
    return df.select(*[e.alias(n) for n, e in fields.items()])


REPORT_FIELDS = ["report", "path", "value"]


def read_report(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A nested JSON report as rows (report, path, value), one per leaf; empty when missing.

    Keys are data (model and label names), so the document is a variant, which knows an object from
    a string that looks like one. A report holds the metrics of a few classes, so one document
    always fits a row. Levels are opened until none is left, one short job each. Strings and
    numbers are given as text, a null as null, an array as its JSON; an empty object is a leaf. A
    document that is no JSON object has no leaves.
    """
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT_FIELDS))
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    level = whole.select(F.lit(name).alias("report"), F.lit("").alias("path"),
                         F.try_parse_json("value").alias("value")).filter(_is_object("value"))
    leaves = none
    while not level.isEmpty():
        named = spark.sql(
            "SELECT report, concat_ws('.', nullif(l.path, ''), e.key) AS path, e.value AS value"
            " FROM {level} l, LATERAL variant_explode(l.value) e", level=level)
        opens = _is_object("value")
        leaves = leaves.unionByName(named.filter(~opens).select(
            "report", "path", _leaf_text("value").alias("value")))
        level = named.filter(opens)
    return leaves


def _kind(value: str) -> Column:
    return F.schema_of_variant(value)


def _is_object(value: str) -> Column:
    """An object with fields."""
    return F.coalesce(_kind(value).startswith("OBJECT<")
                      & (_kind(value) != "OBJECT<>"), F.lit(False))


def _leaf_text(value: str) -> Column:
    """A scalar as text, anything else as JSON."""
    nested = _kind(value).startswith("OBJECT") | _kind(value).startswith("ARRAY")
    return F.when(nested, F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))


def metric_value(report: DataFrame, path: str) -> DataFrame:
    """One metric of a report by its dotted path."""
    return report.filter(F.col("path") == path).select(
        "report", "path", F.col("value").try_cast("double").alias("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
