"""Sources: manifests, page texts, JSON lines, with fixed schemas and integrity checks as rows of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomstack.operators.evaluation import last_rows

CHUNK = "id string, document string, page_start int, page_end int, ordinal int, text string"
EMBEDDING = "id string, values array<float>, seq long"
ENTITY = "struct<name:string,type:string,description:string,aliases:array<string>>"
RELATION = "struct<source:string,target:string,relation:string,evidence:string>"
EXTRACTION = f"chunk string, model string, backend string, status string, stop_reason string, extraction struct<entities:array<{ENTITY}>,relations:array<{RELATION}>>, usage map<string,long>, repairs map<string,long>, error string, seq long"
MANIFEST = "documents array<struct<slug:string,title:string,source_url:string,sha256:string,page_count:int,char_count:long>>"
EQUIVALENTS = "amendment int, passages map<string,array<struct<doc:string,page:int,quote:string>>>"
QUESTION = "id string, kind string, question string, answer string, hops string, gold array<struct<doc:string,page:int,role:string,quote:string>>"


def json_lines(spark: SparkSession, path: str, schema: str, only: list[str] | None = None, key: str = "id", limit: int | None = None) -> DataFrame:
    """Records of JSON lines; blank lines count for nothing. only: keys to keep (none found raises); limit: the first by key."""
    rows = spark.read.schema(schema).json(path)
    if only is not None:
        rows = rows.filter(F.col(key).isin(*only))
        if rows.isEmpty():
            raise ValueError(f"no record has one of these keys: {', '.join(only)}")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; a file that is no JSON raises."""
    found = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return found.select(F.explode("documents").alias("d")).select("d.*")


def equivalents(spark: SparkSession, path: str) -> DataFrame:
    """id, amendment, document, page, quote of a file of equivalents; none if there is no file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "id string, amendment int, document string, page int, quote string")
    found = spark.read.schema(EQUIVALENTS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = found.select("amendment", F.explode("passages").alias("id", "own")).select("id", "amendment", F.explode("own").alias("p"))
    return rows.select("id", "amendment", F.col("p.doc").alias("document"), "p.page", "p.quote")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """document (the file's name without ending) and whole text."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("document"), F.col("value").alias("text"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """document and sha256 of binary files."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("document"), F.sha2("content", 256).alias("sha256"))


def extractions(records: DataFrame) -> DataFrame:
    """The last record of each chunk."""
    return last_rows(records, "chunk")


def done(records: DataFrame) -> DataFrame:
    """chunk and the status of its last record."""
    return records.groupBy("chunk").agg(F.max_by(F.coalesce("status", F.lit("ok")), "seq").alias("status"))


def todo(chunks: DataFrame, records: DataFrame, retry: tuple[str, ...] = ("failed",)) -> DataFrame:
    """Chunks without a record, or whose last one may be tried again."""
    return chunks.join(done(records).filter(~F.col("status").isin(*retry)), chunks["id"] == F.col("chunk"), "left_anti")


def embeddings(records: DataFrame) -> DataFrame:
    return last_rows(records, "id")


def checked_columns(df: DataFrame, schema: str | StructType) -> DataFrame:
    """df, failing if it lacks a column of the schema."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if lacking := [f.name for f in wanted.fields if f.name not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def without_comments(text: Column) -> Column:
    """JSON with comments as plain JSON: strings are matched first, so what they hold stays."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|//[^\n]*|(?s:/\*.*?\*/)', "$1")


def integrity_faults(expected: DataFrame, pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """rule, document where pages (document, page, text) or digests differ from expected (slug, page_count, char_count, sha256)."""
    have = pages.groupBy("document").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    rows = expected.join(have, expected["slug"] == have["document"], "left")
    if found is not None:
        rows = rows.join(found.select(F.col("document").alias("_d"), F.col("sha256").alias("_sha")), F.col("_d") == F.col("slug"), "left")
    else:
        rows = rows.withColumn("_sha", F.col("sha256"))
    faults = F.array(
        F.when(F.col("n").isNull(), "document_missing"),
        F.when(F.col("n") != F.col("page_count"), "page_count"),
        F.when(F.col("chars") != F.col("char_count"), "char_count"),
        F.when(~F.col("sha256").eqNullSafe(F.col("_sha")), "digest"),
    )
    return rows.select(F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("rule"), F.col("slug").alias("document"))


def key_faults(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """rule, id of child keys without a parent row."""
    lost = child.join(parent, child[child_key] == parent[parent_key], "left_anti")
    return lost.select(F.lit(name).alias("rule"), F.col(child_key).cast("string").alias("id")).distinct()


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def missing_keys(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Distinct keys of wanted that have lacks."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")
