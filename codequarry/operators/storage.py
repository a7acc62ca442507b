"""Scans and sinks, run over files and tables that are made of whole small tables (nations stand for source files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.plans.lineage import folder
from codequarry.plans.registry import query
from codequarry.sources import files, sinks
from codequarry.sources.code import Code, pick

col = F.col


def as_files(c: Code) -> DataFrame:
    """path and content: a source file of each nation; some in directories that scans leave out, some of no known language."""
    key = col("n_nationkey")
    name = F.regexp_replace(F.lower("n_name"), "[^a-z]", "_")
    directory = F.when(key % 7 == 3, "node_modules").otherwise(F.concat(F.lit("r"), col("n_regionkey").cast("string")))
    path = F.concat(directory, F.lit("/"), name, pick(key % 4, (".py", ".rs", ".ts", ".txt")))
    return c.table("nation").select(path.alias("path"), F.concat(F.lit("nation "), key.cast("string"), F.lit("\n")).alias("content"))


def written_files(c: Code) -> str:
    """The folder of the written files."""
    where = folder(c.spark, "files")
    sinks.write_files(as_files(c), where)
    return where


FILES = """x AS (SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'node_modules' ELSE 'r' || n_regionkey END || '/' || regexp_replace(lower(n_name), '[^a-z]', '_', 'g') || CASE n_nationkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.ts' ELSE '.txt' END AS path,
CASE n_nationkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'typescript' END AS language, 'nation ' || n_nationkey || chr(10) AS content, n_nationkey % 7 = 3 AS ignored FROM nation)"""


def relative(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join(F.slice(F.split("path", "/"), -2, 2), "/"))


@query(f"WITH {FILES} SELECT path, language, content, sha256(content) AS hash FROM x WHERE language IS NOT NULL AND NOT ignored")
def src01_scan(c):
    return relative(files.scan(c.spark, written_files(c)))


@query(f"WITH {FILES} SELECT path, length(content) AS length FROM x WHERE language IS NOT NULL AND NOT ignored ORDER BY path LIMIT 5")
def src02_discover(c):
    """The first five files of known languages."""
    return relative(files.discover(c.spark, written_files(c), most_files=5))


@query(f"WITH {FILES} SELECT language, COUNT(*) AS n FROM x WHERE language IS NOT NULL AND NOT ignored GROUP BY language")
def src03_languages(c):
    return files.scan(c.spark, written_files(c)).groupBy("language").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'utf-8' AS encoding, length(COALESCE(text, '')) AS n FROM documents")
def src04_decoded(c):
    """Documents' bytes as a reader with fallbacks takes them."""
    own = c.table("documents").select("doc_id", files.lenient(F.coalesce("text", F.lit("")).cast("binary")).alias("x"))
    return own.select("doc_id", "x.encoding", F.length("x.text").alias("n"))


@query("SELECT page_id, regexp_matches(url, '^(https?|git)://[^/]+') AND NOT regexp_matches(url, '^[a-z]+://(localhost|127.0.0.1|0.0.0.0)') AS valid FROM pages")
def src06_valid_addresses(c):
    return c.table("pages").select("page_id", files.valid_url(col("url")).alias("valid"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def snk01_inserted(c):
    """What inserting all nations, twice over and again in part, leaves."""
    own = c.table("nation").select(col("n_nationkey").alias("id"), col("n_name").alias("name"))
    where = folder(c.spark, "inserted")
    sinks.insert(own.unionByName(own), where, ["id"])
    sinks.insert(own.where("id < 9"), where, ["id"])
    return c.spark.read.schema(own.schema).parquet(where)


@query("SELECT id, name, CASE language WHEN 'python' THEN 'python3' ELSE language END AS language FROM f_containers")
def snk02_updated(c):
    changes = c.containers.where("language = 'python'").select("id", F.lit("python3").alias("language"))
    return sinks.updated(c.containers.select("id", "name", "language"), changes, "id")


@query("SELECT n_nationkey AS id FROM nation WHERE false")
def snk03_reset(c):
    own, where = c.table("nation").select(col("n_nationkey").alias("id")), folder(c.spark, "reset")
    own.write.parquet(where)
    sinks.reset(own, where)
    return c.spark.read.schema(own.schema).parquet(where)


@query("SELECT id, source_code FROM f_containers")
def snk04_restored(c):
    """Sources after a backup, their elimination and their restoration."""
    own = c.containers.select("id", "source_code")
    backup = sinks.backed_up(own, "b1", F.current_timestamp())
    return sinks.restored(sinks.eliminated(own), backup, "b1")


@query(f"WITH {FILES} SELECT path, content FROM x")
def snk05_written_files(c):
    """All files as they stand in the folder."""
    return relative(files.raw(c.spark, written_files(c)).select("path", files.decoded(col("content")).alias("content")))


@query("SELECT p_partkey AS id, p_brand AS category, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS FIRST, p_partkey) AS place FROM part")
def r05_templates(c):
    """Templates (parts) of every category, best first, those without a score before all."""
    order = Window.partitionBy("p_brand").orderBy(F.desc_nulls_first("p_retailprice"), "p_partkey")
    return c.table("part").select(col("p_partkey").alias("id"), col("p_brand").alias("category"), F.row_number().over(order).alias("place"))
