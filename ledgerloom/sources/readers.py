"""Readers of external formats, as lazy DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Date formats that are tried in order.
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd"]

READERS: dict = {}


def reader(name: str):
    """Register a reader by name."""
    def add(f):
        READERS[name] = f
        return f

    return add


@reader("csv")
def csv_with_header(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, sep=sep)


@reader("csv_headerless")
def csv_headerless(spark: SparkSession, path: str, features: int) -> DataFrame:
    """txId, time_step, feature_1 ... feature_n by position."""
    fields = [T.StructField("txId", T.StringType()), T.StructField("time_step", T.LongType())]
    fields += [T.StructField(f"feature_{i + 1}", T.DoubleType()) for i in range(features)]
    return spark.read.csv(path, header=False, schema=T.StructType(fields))


@reader("edges_csv")
def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two columns; a header line becomes a row that no account matches."""
    return spark.read.csv(path, header=False, schema="src string, dst string")


@reader("text_files")
def text_files(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """One sample a file, of ``least`` characters or more."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("value").alias("text"), F.input_file_name().alias("file")).where(F.length("text") >= least)


@reader("json_export")
def json_export(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Objects, or lists under records or data; text from narrative, text or description."""
    item = "struct<id:string,narrative:string,text:string,description:string>"
    schema = f"id string, narrative string, text string, description string, records array<{item}>, data array<{item}>"
    rows = spark.read.schema(schema).json(path, multiLine=multi_line)
    own = F.struct("id", "narrative", "text", "description")
    each = rows.select(F.explode(F.coalesce("records", "data", F.array(own))).alias("r")).select("r.*")
    return each.select("id", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("narrative", "text", "description")]).alias("text")).where("text is not null")


@reader("jsonl")
def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def amount(column: Column) -> Column:
    """Digits and points only, as a number; null where that is none."""
    return F.nullif(F.regexp_replace(column, "[^0-9.]", ""), F.lit("")).try_cast("double")


def any_date(column: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in DATE_FORMATS])


def transaction_id(column: Column) -> Column:
    """Numbers and strings as one kind of id: a trailing .0 is dropped."""
    return F.regexp_replace(column.cast("string"), r"\.0$", "")


def first_text(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def url_query(terms: list[str]) -> str:
    """Quoted terms joined by OR."""
    return " OR ".join(f'"{t}"' for t in terms)
