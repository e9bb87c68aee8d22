"""Readers for delimited lists and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Column layouts of the lists the system is fed with.
ISO639_SCHEMA = "part3 string, part2b string, part2t string, part1 string, scope string, type string, ref_name string, comment string"
RANK_SCHEMA = "rank int, host string"
CURATED_HOSTS_SCHEMA = "hostname string, priority string, name_native string, name_latin string, country string, language string, type string"
BIAS_A_SCHEMA = "url string, type string, name string, bias string"
BIAS_B_SCHEMA = "url string, name string, image_pseudoscience string, image_factual string, image_conspiracy string, image_bias string, freedom_rank string, country string"
LABELLED_SCHEMA = "url string, q3 string, perceived smallint, primary_topic string, secondary_topic string, democrat_vote string, republican_vote string"


def read_delimited(
    spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", columns: list[str] | None = None
) -> DataFrame:
    """Delimited files with a header row, every column typed.

    A row that does not fit the schema fails the load. Empty fields are null;
    blanks that pad fixed-width text are trimmed.
    """
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    picked = columns or df.columns
    return df.select(*[F.rtrim(c).alias(c) if c in texts else F.col(c) for c in picked])


def read_ranks(spark: SparkSession, **paths: str) -> DataFrame:
    """Several rank lists as one table with the list's name as a column."""
    out = None
    for name, path in paths.items():
        one = read_delimited(spark, path, RANK_SCHEMA).withColumn("list_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line, as an opaque ``doc`` variant."""
    return spark.read.text(path).select(F.parse_json("value").alias("doc"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Crawl ids from the published catalogue, a JSON array of objects."""
    return spark.read.schema("id string").option("multiLine", True).json(path).select("id")
