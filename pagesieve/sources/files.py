"""Files of the pipeline: prediction TSV, text and gold CSV, feature JSON lines, manifests; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.operators.features import feature_json

PREDICTIONS = "Url STRING, TextNodeId INT, Task STRING"
TEXTNODES = "Url STRING, TextNodeId INT, Text STRING"
GOLD = TEXTNODES + ", JudgmentIsPrimary BOOLEAN"
FEATURES = "Labels ARRAY<ARRAY<INT>>, TokenId ARRAY<ARRAY<INT>>, NodeIds ARRAY<INT>, Url ARRAY<STRING>"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=PREDICTIONS, sep="\t", header=True, quote="", enforceSchema=True)


def read_textnodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=TEXTNODES, header=True, multiLine=True, escape='"', lineSep="\n")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=GOLD, header=True, multiLine=True, escape='"', lineSep="\n")


def read_gold_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=GOLD, sep="\t", header=True, quote="")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(feature rows, lines that are no JSON object of the schema)."""
    lines = spark.read.text(path).select("value", F.from_json("value", FEATURES + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return lines.where(~bad).select("r.Labels", "r.TokenId", "r.NodeIds", "r.Url"), lines.where(bad).select("value")


def list_data_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files below whose name holds tsv or json and not offset."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.substring_index("path", "/", -1)
    return found.where((name.contains("tsv") | name.contains("json")) & ~name.contains("offset"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(zip, entry) from a JSON list of names."""
    names = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("zip"))
    return names.select("zip", entry_of(F.col("zip")).alias("entry"))


def entry_of(name: Column) -> Column:
    return F.substring_index(name, "-", 1)


def tsv_name(path: Column) -> Column:
    """The file name before .tsv."""
    return F.regexp_extract(path, "([^\\\\/]+)(?=\\.tsv)", 1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, "\\.[^.]*$", "")


def before_dot(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of text files with their place, for reads by place instead of a byte-offset map."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\n\\z", ""), "\n").alias("lines"))
    return lines.select("file", F.posexplode("lines").alias("line_no", "value"))


def write_features(chunks: DataFrame, path: str, mode: str = "append") -> None:
    feature_json(chunks).write.mode(mode).text(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).csv(path, header=True, escape='"', lineSep="\n")


def write_tsv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).csv(path, header=True, sep="\t", quote="")


def response(text: Column) -> Column:
    """The service's JSON answer; a page without a text answers null."""
    return F.to_json(F.struct(text.alias("Text")), {"ignoreNullFields": "false"})
