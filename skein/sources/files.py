"""Folders of files: topics with frontmatter, documents, source trees, and tables behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import frontmatter

#: Folders that hold no source of one's own.
EXCLUDED = ("node_modules", ".git", "dist", "build", "vendor", "coverage", "__pycache__", ".venv", "target")


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text) of all files below a folder (S15, S16); excluded folders are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    out = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED))))


def topics(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, when, keywords, always) of topic files (S14); names that start with _ are left out."""
    t = texts(spark, root, "*.md").where(~F.element_at(F.split("path", "/"), -1).startswith("_"))
    words = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(frontmatter(F.col("text"), "keywords"), F.lit("")), r"[\[\]]", ""), ","), lambda w: F.trim(w)), lambda w: F.length(w) > 0)
    return t.select("path", frontmatter(F.col("text"), "title").alias("title"), frontmatter(F.col("text"), "when").alias("when"), words.alias("keywords"), F.coalesce(F.lower(frontmatter(F.col("text"), "always")) == "true", F.lit(False)).alias("always"))


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, doc_sha) of documents below a folder (S15); reviews and findings are left out."""
    t = texts(spark, root, "*.md")
    stem = F.lower(F.element_at(F.split("path", "/"), -1))
    return t.where(~stem.rlike(r"(^|[-_.])(review|findings?)s?([-_.]|$)")).withColumn("doc_sha", F.sha2("text", 256))


def catalog_columns(spark: SparkSession, url: str, properties: dict[str, str]) -> DataFrame:
    """(table_schema, table_name, column_name, data_type) behind JDBC (S17, S18); the driver's jar must be on the class path."""
    sql = "(select table_schema, table_name, column_name, data_type from information_schema.columns) c"
    return spark.read.jdbc(url, sql, properties=properties)


def schema_graph(columns: DataFrame, keys: DataFrame, extractor: str = "db") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a database (X11) from columns(table_schema, table_name, column_name) and keys(from_table, to_table)."""
    table = F.concat_ws(".", "table_schema", "table_name")
    tables = columns.select(F.lit("table").alias("kind"), table.alias("qualified_name")).distinct()
    cols = columns.select(F.lit("column").alias("kind"), F.concat_ws(".", table, F.col("column_name")).alias("qualified_name"))
    defines = columns.select(F.lit("defines").alias("relation"), table.alias("from_name"), F.concat_ws(".", table, F.col("column_name")).alias("to_name"))
    refs = keys.select(F.lit("fk_to").alias("relation"), F.col("from_table").alias("from_name"), F.col("to_table").alias("to_name")).distinct()
    return tables.unionByName(cols).withColumn("extracted_by", F.lit(extractor)), defines.unionByName(refs)
