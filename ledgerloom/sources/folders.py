"""Loaders of folders as they are downloaded: narratives as text files, exports as JSON, a graph as three CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ledgerloom.functions import text as T
from ledgerloom.sources import readers
from ledgerloom.sources.loaders import require_files, sample

# Names of a graph's files, and the fields of a record that may hold its text (the first that is not empty counts).
ELLIPTIC_FILES = ["elliptic_txs_features.csv", "elliptic_txs_classes.csv", "elliptic_txs_edgelist.csv"]
TEXT_FIELDS = ["narrative", "text", "description"]


def _stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1)


def _report(text: Column, sample_id: Column) -> list[Column]:
    """The common sample columns of a suspicious report."""
    return sample(text, "fincen_files", sample_id, F.lit("sar_narrative"), F.lit("suspicious"), {}, entities=T.entities(text), typologies=T.tags(text, T.TYPOLOGIES), indicators=T.phrases(text, T.INDICATORS))


@readers.reader("narrative_folder")
def narrative_folder(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """One sample a ``*.txt`` file, without white space around it, of ``least`` characters or more; ids from file names.

    A file is one row and must fit in a task; other files of the folder are left alone, files of no bytes
    give no sample whatever ``least`` is, and a folder without any is an empty table.
    """
    files = spark.read.format("text").options(wholetext=True, pathGlobFilter="*.txt").schema("value string").load(path)
    rows = files.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"), F.concat(F.lit("fincen_narrative_"), _stem(F.input_file_name())).alias("id"))
    return rows.where(F.length("text") >= least).select(*_report(F.col("text"), F.col("id")))


@readers.reader("json_folder")
def json_folder(spark: SparkSession, path: str, least: int = 50, lines: bool = False) -> DataFrame:
    """Samples of JSON documents: a list of records, an object with a list under ``records`` or else ``data``, or one record.

    A file is one document, or each of its lines is one with ``lines``, which Spark splits. Text is the first of TEXT_FIELDS that is not
    empty, of ``least`` characters or more. The id ends with the record's place in its document; with ``lines`` a digest of the document
    comes before it. What is no JSON or no object gives no rows. ``metadata`` holds the whole record.
    """
    documents = spark.read.format("text").options(wholetext=not lines).schema("value string").load(path)
    name = _stem(F.input_file_name())
    rows = documents.select(F.trim("value").alias("d"), F.concat_ws("_", name, F.substring(F.sha1("value"), 1, 12)).alias("n") if lines else name.alias("n"))
    under = F.coalesce(F.get_json_object("d", "$.records"), F.get_json_object("d", "$.data"))
    listed = F.when(F.col("d").startswith("["), F.col("d")).otherwise(under)
    each = F.when(listed.isNull(), F.array("d")).otherwise(F.from_json(listed, "array<string>"))
    records = rows.select("n", F.posexplode(each).alias("place", "r")).where(F.col("r").startswith("{"))
    text = F.coalesce(*[F.nullif(F.get_json_object("r", f"$.{f}"), F.lit("")) for f in TEXT_FIELDS])
    kept = records.withColumn("t", text).where(F.length("t") >= least)
    out = _report(F.col("t"), F.concat_ws("_", F.lit("fincen_json"), "n", "place"))
    return kept.select(*out[:-1], F.from_json("r", "map<string,string>").alias("metadata"))


@readers.reader("elliptic_folder")
def elliptic_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, edges) of a folder with ELLIPTIC_FILES; a FileNotFoundError lists those that are missing.

    Features have no header; how many there are is read from the first line. Transactions without a class are ``unknown``
    and have no label. Edges are all lines of their file: a header is an edge between accounts that don't exist.
    """
    at = [f"{folder.rstrip('/')}/{f}" for f in ELLIPTIC_FILES]
    require_files(spark, at)
    first = spark.read.text(at[0]).limit(1).collect()
    features = readers.csv_headerless(spark, at[0], max(0, first[0].value.count(",") - 1) if first else 0)
    classes = spark.read.csv(at[1], header=True, schema=Y.StructType([Y.StructField("txId", Y.StringType()), Y.StructField("class", Y.StringType())]))
    label = F.coalesce("class", F.lit("unknown"))
    flags = {"class": label, "label_illicit": (label == "1").cast("int"), "label_licit": (label == "2").cast("int"), "is_labeled": label.isin("1", "2").cast("int")}
    return features.join(classes, "txId", "left").withColumns(flags), readers.edges_csv(spark, at[2])
