"""Lookups by key, by filter and by recency over the code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.screens import first_match, function, tested
from codequarry.plans.registry import query

col = F.col
#: By relationship type; all others are references to variables.
DEPENDENCY_TYPES = {"calls": "FunctionCall", "imports": "Import", "inherits": "ClassInheritance", "uses_type": "TypeReference", "module_ref": "ModuleReference"}


@query("SELECT id, name, language, original_path, created_at FROM f_containers WHERE id = 33")
def src07_container_by_id(c):
    return c.containers.where("id = 33").select("id", "name", "language", "original_path", "created_at")


@query("SELECT id, block_type, semantic_name, position FROM f_blocks WHERE container_id = 33")
def src07_blocks_by_container(c):
    return c.blocks.where("container_id = 33").select("id", "block_type", "semantic_name", "position").orderBy("position")


@query("SELECT id, repository_name, created_at FROM f_migrations ORDER BY created_at DESC, id DESC LIMIT 1")
def src08_latest_migration(c):
    return c.migrations.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


@query("SELECT id, name, source_code FROM f_containers WHERE source_code IS NOT NULL AND source_code <> ''")
def src09_containers_with_source(c):
    return c.containers.where("source_code IS NOT NULL AND source_code <> ''").select("id", "name", "source_code")


def random_rows(df, n: int, seed: int = 7):
    """n rows at random, the same for a seed and the same files."""
    return df.orderBy(F.rand(seed)).limit(n)


@query()
def src10_random_containers(c):
    return random_rows(c.containers.select("id", "name", "language"), 20)


@query()
def src11_columns(c):
    """Every column of the code tables, by table: name, type, nullable."""
    tables = {"migrations": c.migrations, "containers": c.containers, "blocks": c.blocks, "relationships": c.relationships, "versions": c.versions, "changes": c.changes}
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for f in df.schema]
    return c.spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")


@query("SELECT migration_id, id, block_type, semantic_name FROM f_blocks")
def r01_blocks_by_migration(c):
    return c.blocks.select("migration_id", "id", "block_type", "semantic_name")


@query("SELECT b.migration_id, r.source_block_id, r.target_block_id, r.relationship_type FROM f_relationships r JOIN f_blocks b ON b.id = r.source_block_id")
def r01_relationships_by_migration(c):
    return c.relationships.join(c.blocks.select(col("id").alias("source_block_id"), "migration_id"), "source_block_id").select("migration_id", "source_block_id", "target_block_id", "relationship_type")


@query("SELECT b.container_id, r.source_block_id, r.target_block_id, r.relationship_type FROM f_relationships r JOIN f_blocks b ON b.id = r.source_block_id")
def r02_relationships_by_container(c):
    return c.relationships.join(c.blocks.select(col("id").alias("source_block_id"), "container_id"), "source_block_id").select("container_id", "source_block_id", "target_block_id", "relationship_type")


@query("SELECT block_id, COALESCE(MAX(version_number), 0) AS latest FROM f_versions GROUP BY block_id")
def r03_latest_version(c):
    return c.versions.groupBy("block_id").agg(F.coalesce(F.max("version_number"), F.lit(0)).alias("latest"))


@query("SELECT block_id, version_number, semantic_hash, created_at, ROW_NUMBER() OVER (PARTITION BY block_id ORDER BY version_number DESC) AS age FROM f_versions")
def r04_versions(c):
    newest = Window.partitionBy("block_id").orderBy(F.desc("version_number"))
    return c.versions.select("block_id", "version_number", "semantic_hash", "created_at").withColumn("age", F.row_number().over(newest))


@query("SELECT semantic_hash, COUNT(*) AS n, COUNT(DISTINCT block_id) AS n_blocks FROM f_versions GROUP BY semantic_hash HAVING COUNT(*) > 1")
def r04_hash_duplicates(c):
    return c.versions.groupBy("semantic_hash").agg(F.count("*").alias("n"), F.countDistinct("block_id").alias("n_blocks")).where("n > 1")


@query("""WITH hit AS (SELECT id, 'async_function' AS pattern, 0.9::DOUBLE AS confidence FROM f_blocks WHERE block_type = 'Function' AND starts_with(lower(raw_text), 'async ') UNION ALL
SELECT id, 'untested_function', 1.0 FROM f_blocks WHERE block_type = 'Function' AND id NOT IN (SELECT target_block_id FROM f_relationships WHERE relationship_type = 'tests') UNION ALL SELECT id, 'complex_function', 0.8 FROM f_blocks WHERE block_type = 'Function' AND cc > 10) SELECT * FROM hit""")
def r07_find_pattern(c):
    """All three patterns that can be asked for; the threshold of complexity is 10."""
    own = c.blocks.where(function())
    hit = lambda df, name, sure: df.select("id", F.lit(name).alias("pattern"), F.lit(sure).alias("confidence"))
    plain = hit(own.where(col("raw_text").ilike("async %")), "async_function", 0.9).unionByName(hit(own.where("cc > 10"), "complex_function", 0.8))
    return plain.unionByName(hit(own.join(tested(c), "id", "left_anti"), "untested_function", 1.0))


@query("SELECT c.id, c.name, c.language, c.original_path, COUNT(b.id) AS n_blocks FROM f_containers c LEFT JOIN f_raw b ON b.container_id = c.id GROUP BY ALL ORDER BY c.id LIMIT 200")
def r09_containers(c):
    """The first 200 containers with their blocks' number."""
    first = c.containers.select("id", "name", "language", "original_path").orderBy("id").limit(200)
    n = c.blocks.groupBy(col("container_id").alias("id")).agg(F.count("*").alias("n_blocks"))
    return first.join(n, "id", "left").fillna(0, ["n_blocks"])


@query("""SELECT r.source_block_id, s.semantic_name AS source_name, r.target_block_id, t.semantic_name AS target_name, r.relationship_type FROM f_relationships r JOIN f_blocks s ON s.id = r.source_block_id JOIN f_blocks t ON t.id = r.target_block_id
WHERE r.relationship_type = 'tests' ORDER BY r.source_block_id, r.target_block_id LIMIT 100""")
def r10_analyze_relationships(c):
    name = lambda k: c.blocks.select(col("id").alias(f"{k}_block_id"), col("semantic_name").alias(f"{k}_name"))
    own = c.relationships.where("relationship_type = 'tests'").join(name("source"), "source_block_id").join(name("target"), "target_block_id")
    return own.orderBy("source_block_id", "target_block_id").limit(100)


@query("""SELECT id, '// Generated code for block: ' || COALESCE(semantic_name, 'unnamed') AS code, file_name || '.gen' AS path, 1 AS n_lines FROM f_blocks""")
def r11_generate_code(c):
    made = F.concat(F.lit("// Generated code for block: "), F.coalesce("semantic_name", F.lit("unnamed")))
    return c.blocks.select("id", made.alias("code"), F.concat("file_name", F.lit(".gen")).alias("path"), F.lit(1).alias("n_lines"))


@query("""SELECT container_id, ROUND((COUNT(parameters)::DOUBLE / COUNT(*) + COUNT(return_type)::DOUBLE / COUNT(*) + COUNT(CASE WHEN starts_with(lower(raw_text), 'async ') THEN 1 END)::DOUBLE / COUNT(*) + COUNT(body_ast)::DOUBLE / COUNT(*) + COUNT(language_features)::DOUBLE / COUNT(*)) / 5, 6) AS completeness FROM f_blocks GROUP BY container_id
UNION ALL SELECT id, 0.0 FROM f_containers WHERE id NOT IN (SELECT container_id FROM f_blocks)""")
def r24_completeness(c):
    """Mean of five shares of blocks that have a part; 0 for a container without blocks."""
    parts = [F.count(x) / F.count("*") for x in (col("parameters"), col("return_type"), F.when(col("raw_text").ilike("async %"), 1), col("body_ast"), col("language_features"))]
    per = c.blocks.groupBy("container_id").agg(F.round(sum(parts[1:], parts[0]) / 5, 6).alias("completeness"))
    return c.containers.select(col("id").alias("container_id")).join(per, "container_id", "left").fillna(0.0, ["completeness"])


@query("SELECT lower(language) AS language, COUNT(*) AS n FROM f_containers WHERE language IS NOT NULL GROUP BY 1")
def r25_language_coverage(c):
    return c.containers.where("language IS NOT NULL").groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("n"))


@query("""SELECT COUNT(*) >= 100 AND COUNT(CASE WHEN language = 'python' THEN 1 END) >= 10 AND COUNT(CASE WHEN language = 'rust' THEN 1 END) >= 10 AND COUNT(CASE WHEN language = 'javascript' THEN 1 END) >= 10
AND COUNT(CASE WHEN language = 'typescript' THEN 1 END) >= 10 AS ready FROM f_containers""")
def r26_readiness(c):
    enough = F.count("*") >= 100
    for x in ("python", "rust", "javascript", "typescript"):
        enough = enough & (F.count_if(col("language") == x) >= 10)
    return c.containers.agg(enough.alias("ready"))


@query("SELECT COUNT(source_code) AS remaining, COUNT(source_code) = 0 AS eliminated FROM f_containers")
def r27_remaining_sources(c):
    return c.containers.agg(F.count("source_code").alias("remaining"), (F.count("source_code") == 0).alias("eliminated"))


#: Blocks of a large container.
LARGE = 1000


def large_containers(blocks: DataFrame, more_than: int = LARGE, most: int = 3) -> DataFrame:
    """The largest of all files and folders (container) that hold more than so many blocks (original_path), and how many they hold."""
    parts = F.split("original_path", "/")
    within = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    held = blocks.select("original_path").groupBy("original_path").agg(F.count("*").alias("n"))
    return held.select(F.explode(within).alias("container"), "n").groupBy("container").agg(F.sum("n").alias("n")).where(col("n") > more_than).orderBy(F.desc("n"), "container").limit(most)


@query("""SELECT container, COUNT(*) AS n FROM (SELECT unnest([split_part(original_path, '/', 1), split_part(original_path, '/', 1) || '/' || split_part(original_path, '/', 2), original_path]) AS container FROM f_blocks) GROUP BY container HAVING COUNT(*) > 1000 ORDER BY n DESC, container LIMIT 3""")
def r28_large_containers(c):
    """A container is a file or a folder with all that stands below it."""
    return large_containers(c.blocks)


@query("""SELECT COUNT(*) AS n_backup, COUNT(CASE WHEN saved IS NULL OR saved = '' THEN 1 END) AS corrupted, COUNT(CASE WHEN saved IS DISTINCT FROM source_code THEN 1 END) AS mismatched FROM f_containers JOIN f_backup USING (id)""")
def r29_backup_integrity(c):
    """A backup (id, saved) held against what it was made of."""
    both = c.containers.select("id", "source_code").join(c.backup, "id")
    return both.agg(F.count("*").alias("n_backup"), F.count_if(col("saved").isNull() | (col("saved") == "")).alias("corrupted"), F.count_if(~col("saved").eqNullSafe(col("source_code"))).alias("mismatched"))


@query("SELECT DISTINCT block_type FROM f_blocks WHERE container_id IN (SELECT id FROM f_containers ORDER BY id LIMIT 50)")
def r30_block_types(c):
    return c.blocks.join(c.containers.select(col("id").alias("container_id")).orderBy("container_id").limit(50), "container_id", "left_semi").select("block_type").distinct()


@query("SELECT id, ROW_NUMBER() OVER (PARTITION BY container_id ORDER BY position, indent, parent_block_id NULLS FIRST) AS place FROM f_blocks")
def r31_ordered_blocks(c):
    order = Window.partitionBy("container_id").orderBy("position", "indent", F.asc_nulls_first("parent_block_id"))
    return c.blocks.select("id", F.row_number().over(order).alias("place"))


@query("SELECT id, original_path, split_part(original_path, '/', -1) AS repo_name FROM f_containers")
def r32_repo_names(c):
    return c.containers.select("id", "original_path", F.split_part("original_path", F.lit("/"), F.lit(-1)).alias("repo_name"))


@query("""SELECT b AS block_id, source_block_id, target_block_id, CASE relationship_type WHEN 'calls' THEN 'FunctionCall' WHEN 'imports' THEN 'Import' WHEN 'inherits' THEN 'ClassInheritance' WHEN 'uses_type' THEN 'TypeReference' WHEN 'module_ref' THEN 'ModuleReference' ELSE 'VariableReference' END AS dependency_type
FROM (SELECT source_block_id AS b, * FROM f_relationships UNION ALL SELECT target_block_id, * FROM f_relationships WHERE source_block_id <> target_block_id)""")
def r33_block_dependencies(c):
    """Edges on either side of every block; an edge to itself once."""
    kind = first_match(*((col("relationship_type") == k, v) for k, v in DEPENDENCY_TYPES.items()), other="VariableReference")
    return c.relationships.select(F.explode(F.array_distinct(F.array("source_block_id", "target_block_id"))).alias("block_id"), "source_block_id", "target_block_id", kind.alias("dependency_type"))
