"""Quality screens over blocks: names, texts, counts and couplings."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.plans.registry import query
from codequarry.sources.code import Code

col, when = F.col, F.when
PLACE = ("id", "semantic_name", "file_name", "language")
WORDS = ("select", "insert", "update", "delete")
#: Parts of the edges in a task that takes pairs once: tasks are the more even, the more they are.
PARTS = 64


def function() -> Column:
    return col("block_type") == "Function"


def holds(column: str, *parts: str) -> Column:
    """Any part stands in the column, in either case."""
    return reduce(or_, (col(column).ilike(f"%{p}%") for p in parts))


def param_count() -> Column:
    return F.size(F.split("parameters", ","))


def first_match(*cases: tuple[Column, str], other: str | None = None) -> Column:
    out = reduce(lambda w, c: w.when(*c), cases[1:], when(*cases[0]))
    return out.otherwise(other) if other else out


def many(kind: str) -> Column:
    return F.count(when(col("block_type") == kind, 1))


def tested(c: Code) -> DataFrame:
    """Targets of tests edges, once each."""
    return c.relationships.where("relationship_type = 'tests'").select(col("target_block_id").alias("id")).distinct()


def flagged_tested(c: Code) -> DataFrame:
    return c.blocks.join(tested(c).withColumn("has_test", F.lit(True)), "id", "left")


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(when(whole == 0, 0.0).otherwise(100.0 * part / whole), digits)


def coupling(c: Code) -> DataFrame:
    """id, ce and ca: distinct targets and sources of every block with an edge, in one pass over the edges, dealt by id.

    Pairs are dealt by PARTS parts a task, and each part sums its own, so that a hub is a row of each part to the task of its id."""
    edges = c.pairs().withColumn("part", F.pmod(F.xxhash64("s", "t"), F.lit(PARTS * c.edge_tasks))).repartition(c.edge_tasks, "part").distinct()
    ends = edges.select("part", F.explode(F.array(F.struct(col("s").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(col("t").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    sums = ends.groupBy("part", "x.id").agg(F.sum("x.o").alias("ce"), F.sum("x.i").alias("ca"))
    return c.dealt(sums).groupBy("id").agg(F.sum("ce").alias("ce"), F.sum("ca").alias("ca"))


def instability() -> Column:
    return F.round(when(col("ce") + col("ca") == 0, 0.0).otherwise(col("ce") / (col("ce") + col("ca"))), 6)


@query("""SELECT b.id, b.semantic_name, b.file_name, b.language, b.position, b.cc AS complexity FROM f_blocks b LEFT JOIN f_relationships r ON b.id = r.target_block_id AND r.relationship_type = 'tests'
WHERE b.block_type = 'Function' AND r.source_block_id IS NULL AND b.semantic_name IS NOT NULL""")
def v01_untested_functions(c):
    return c.blocks.where(function() & col("semantic_name").isNotNull()).join(tested(c), "id", "left_anti").select(*PLACE, "position", col("cc").alias("complexity"))


@query("SELECT id, semantic_name, file_name, language, cc AS complexity, cognitive AS cognitive_complexity, param_count, position FROM f_blocks WHERE block_type = 'Function' AND cc > 10")
def v02_complex_functions(c):
    return c.blocks.where(function() & (col("cc") > 10)).select(*PLACE, col("cc").alias("complexity"), col("cognitive").alias("cognitive_complexity"), param_count().alias("param_count"), "position")


@query("SELECT id, semantic_name, file_name, language, param_count, parameters, position FROM f_blocks WHERE block_type = 'Function' AND param_count > 5")
def v03_many_parameters(c):
    return c.blocks.where(function() & (param_count() > 5)).select(*PLACE, param_count().alias("param_count"), "parameters", "position")


@query("""SELECT semantic_name, COUNT(*) AS occurrence_count, array_to_string(list_sort(array_agg(DISTINCT language) FILTER (language IS NOT NULL)), ',') AS languages,
array_to_string(list_sort(array_agg(file_name)), ',') AS files, array_to_string(list_sort(array_agg(id)), ',') AS block_ids FROM f_blocks WHERE block_type = 'Function' AND semantic_name IS NOT NULL GROUP BY semantic_name HAVING COUNT(*) > 1""")
def v04_duplicate_names(c):
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    named = c.blocks.where(function() & col("semantic_name").isNotNull()).groupBy("semantic_name")
    return named.agg(F.count("*").alias("occurrence_count"), listed(F.collect_set("language")).alias("languages"), listed(F.collect_list("file_name")).alias("files"), listed(F.collect_list("id")).alias("block_ids")).where("occurrence_count > 1")


@query("""SELECT id, semantic_name, file_name, language, raw_text AS code_snippet, position FROM f_blocks WHERE block_type = 'Function'
AND (raw_text ILIKE '%execute(%' OR raw_text ILIKE '%query(%' OR raw_text ILIKE '%SELECT%' OR raw_text ILIKE '%INSERT%' OR raw_text ILIKE '%UPDATE%' OR raw_text ILIKE '%DELETE%')
AND (raw_text ILIKE '%+%' OR raw_text ILIKE '%format%' OR raw_text ILIKE '%f"%' OR raw_text ILIKE '%${%')""")
def v05_sql_injection_risks(c):
    risky = holds("raw_text", "execute(", "query(", *WORDS) & holds("raw_text", "+", "format", 'f"', "${")
    return c.blocks.where(function() & risky).select(*PLACE, col("raw_text").alias("code_snippet"), "position")


@query("""SELECT id, semantic_name, file_name, language, raw_text AS code_snippet, position FROM f_blocks WHERE block_type IN ('Variable', 'Function') AND (semantic_name ILIKE '%password%' OR semantic_name ILIKE '%secret%' OR semantic_name ILIKE '%key%'
OR semantic_name ILIKE '%token%' OR semantic_name ILIKE '%api_key%' OR raw_text ILIKE '%password%=%' OR raw_text ILIKE '%secret%=%' OR raw_text ILIKE '%token%=%')""")
def v06_hardcoded_secrets(c):
    hidden = holds("semantic_name", "password", "secret", "key", "token") | holds("raw_text", "password%=", "secret%=", "token%=")
    return c.blocks.where(col("block_type").isin("Variable", "Function") & hidden).select(*PLACE, col("raw_text").alias("code_snippet"), "position")


@query("""SELECT id, semantic_name, file_name, language, raw_text AS code_snippet, position FROM f_blocks WHERE block_type = 'Function'
AND (raw_text ILIKE '%eval(%' OR raw_text ILIKE '%exec(%' OR raw_text ILIKE '%subprocess%' OR raw_text ILIKE '%shell=True%' OR raw_text ILIKE '%os.system%')""")
def v07_unsafe_execution(c):
    return c.blocks.where(function() & holds("raw_text", "eval(", "exec(", "subprocess", "shell=true", "os.system")).select(*PLACE, col("raw_text").alias("code_snippet"), "position")


@query("""SELECT id, semantic_name, file_name, language, position, cc AS complexity FROM f_blocks WHERE block_type = 'Function' AND cc > 15
AND (raw_text ILIKE '%for%for%' OR raw_text ILIKE '%while%while%' OR raw_text ILIKE '%for%while%')""")
def v08_nested_loops(c):
    return c.blocks.where(function() & (col("cc") > 15) & holds("raw_text", "for%for", "while%while", "for%while")).select(*PLACE, "position", col("cc").alias("complexity"))


@query("""SELECT c.language, COUNT(DISTINCT c.id) AS file_count, COUNT(b.id) AS block_count, ROUND(AVG(b.cc), 6) AS avg_complexity, MAX(b.cc) AS max_complexity, COUNT(CASE WHEN block_type = 'Function' THEN 1 END) AS function_count,
COUNT(CASE WHEN block_type = 'Class' THEN 1 END) AS class_count, COUNT(CASE WHEN block_type = 'Module' THEN 1 END) AS module_count, COUNT(CASE WHEN block_type = 'Interface' THEN 1 END) AS interface_count
FROM f_containers c LEFT JOIN f_raw b ON b.container_id = c.id GROUP BY c.language""")
def v09_language_statistics(c):
    per = c.blocks.groupBy("container_id").agg(F.count("*").alias("n"), F.sum("cc").alias("cc"), F.count("cc").alias("n_cc"), F.max("cc").alias("most"), *(many(k).alias(k) for k in ("Function", "Class", "Module", "Interface")))
    files = c.containers.select(col("id").alias("container_id"), "language").join(per, "container_id", "left").groupBy("language")
    total = lambda k: F.coalesce(F.sum(k), F.lit(0))
    return files.agg(F.count("*").alias("file_count"), total("n").alias("block_count"), F.round(F.sum("cc") / F.sum("n_cc"), 6).alias("avg_complexity"), F.max("most").alias("max_complexity"), *(total(k).alias(f"{k.lower()}_count") for k in ("Function", "Class", "Module", "Interface")))


@query("""SELECT id, semantic_name, file_name, language, CASE WHEN cc > 10 THEN 'High Complexity' WHEN loc > 50 THEN 'Long Method' WHEN param_count > 5 THEN 'Too Many Parameters'
WHEN semantic_name ILIKE '%manager%' AND semantic_name ILIKE '%handler%' THEN 'God Object' WHEN raw_text ILIKE '%if%if%if%if%' THEN 'Complex Conditionals' END AS smell_type, position
FROM f_blocks WHERE cc > 10 OR loc > 50 OR param_count > 5 OR (semantic_name ILIKE '%manager%' AND semantic_name ILIKE '%handler%') OR raw_text ILIKE '%if%if%if%if%'""")
def v10_code_smells(c):
    smell = first_match((col("cc") > 10, "High Complexity"), (col("loc") > 50, "Long Method"), (param_count() > 5, "Too Many Parameters"), (holds("semantic_name", "manager") & holds("semantic_name", "handler"), "God Object"), (holds("raw_text", "if%if%if%if"), "Complex Conditionals"))
    return c.blocks.select(*PLACE, smell.alias("smell_type"), "position").where("smell_type IS NOT NULL")


@query("""SELECT b.id, b.semantic_name, b.file_name, b.language, COALESCE(o.n, 0) AS efferent_coupling, COALESCE(i.n, 0) AS afferent_coupling, ROUND(CASE WHEN COALESCE(o.n, 0) + COALESCE(i.n, 0) = 0 THEN 0 ELSE COALESCE(o.n, 0) / (COALESCE(o.n, 0) + COALESCE(i.n, 0)) END, 6) AS instability, b.position
FROM f_blocks b LEFT JOIN (SELECT source_block_id AS k, COUNT(DISTINCT target_block_id) AS n FROM f_relationships GROUP BY source_block_id) o ON o.k = b.id LEFT JOIN (SELECT target_block_id AS k, COUNT(DISTINCT source_block_id) AS n FROM f_relationships GROUP BY target_block_id) i ON i.k = b.id
WHERE b.block_type IN ('Function', 'Class', 'Module') AND (COALESCE(o.n, 0) > 5 OR COALESCE(i.n, 0) > 10)""")
def v11_dependency_analysis(c):
    close = coupling(c).where("ce > 5 OR ca > 10")
    own = c.dealt(c.blocks.where(col("block_type").isin("Function", "Class", "Module")))
    return own.join(close, "id").select(*PLACE, col("ce").alias("efferent_coupling"), col("ca").alias("afferent_coupling"), instability().alias("instability"), "position")


@query("""SELECT c.language, COUNT(DISTINCT CASE WHEN b.block_type = 'Function' THEN b.id END) AS total_functions, COUNT(DISTINCT CASE WHEN b.block_type = 'Function' AND r.source_block_id IS NOT NULL THEN b.id END) AS tested_functions,
ROUND(CASE WHEN COUNT(DISTINCT CASE WHEN b.block_type = 'Function' THEN b.id END) = 0 THEN 0 ELSE 100.0 * COUNT(DISTINCT CASE WHEN b.block_type = 'Function' AND r.source_block_id IS NOT NULL THEN b.id END)::DOUBLE / COUNT(DISTINCT CASE WHEN b.block_type = 'Function' THEN b.id END) END, 6) AS test_coverage_percentage
FROM f_containers c LEFT JOIN f_raw b ON b.container_id = c.id LEFT JOIN f_relationships r ON r.target_block_id = b.id AND r.relationship_type = 'tests' GROUP BY c.language""")
def v12_test_coverage(c):
    n = flagged_tested(c).where(function()).groupBy("language").agg(F.count("*").alias("n"), F.count("has_test").alias("t"))
    out = c.containers.select("language").distinct().alias("l").join(n.alias("n"), col("l.language").eqNullSafe(col("n.language")), "left")
    whole, part = F.coalesce("n.n", F.lit(0)), F.coalesce("n.t", F.lit(0))
    return out.select("l.language", whole.alias("total_functions"), part.alias("tested_functions"), share(part, whole).alias("test_coverage_percentage"))


@query("""SELECT * FROM (SELECT id, semantic_name, file_name, language, CASE WHEN semantic_name ILIKE '%factory%' THEN 'Factory Pattern' WHEN semantic_name ILIKE '%singleton%' THEN 'Singleton Pattern'
WHEN semantic_name ILIKE '%observer%' OR semantic_name ILIKE '%listener%' THEN 'Observer Pattern' WHEN semantic_name ILIKE '%adapter%' THEN 'Adapter Pattern' WHEN semantic_name ILIKE '%decorator%' THEN 'Decorator Pattern'
WHEN semantic_name ILIKE '%facade%' THEN 'Facade Pattern' WHEN semantic_name ILIKE '%strategy%' THEN 'Strategy Pattern' WHEN semantic_name ILIKE '%command%' THEN 'Command Pattern'
WHEN raw_text ILIKE '%getInstance%' THEN 'Singleton Pattern' WHEN raw_text ILIKE '%addObserver%' THEN 'Observer Pattern' END AS pattern_type, position FROM f_blocks) WHERE pattern_type IS NOT NULL""")
def v13_architecture_patterns(c):
    named = lambda *x: holds("semantic_name", *x)
    plain = [(named(x.lower()), f"{x} Pattern") for x in ("Adapter", "Decorator", "Facade", "Strategy", "Command")]
    kind = first_match((named("factory"), "Factory Pattern"), (named("singleton"), "Singleton Pattern"), (named("observer", "listener"), "Observer Pattern"), *plain, (holds("raw_text", "getinstance"), "Singleton Pattern"), (holds("raw_text", "addobserver"), "Observer Pattern"))
    return c.blocks.select(*PLACE, kind.alias("pattern_type"), "position").where("pattern_type IS NOT NULL")


@query("""SELECT m.id AS migration_id, m.repository_name, m.created_at, (SELECT COUNT(*) FROM f_containers c WHERE c.migration_id = m.id) AS total_containers, COUNT(b.id) AS total_blocks, COUNT(b.semantic_name) AS named_blocks,
ROUND(CASE WHEN COUNT(b.id) = 0 THEN 0 ELSE 100.0 * COUNT(b.semantic_name)::DOUBLE / COUNT(b.id) END, 6) AS semantic_coverage_percentage, ROUND(AVG(b.cc), 6) AS avg_complexity,
(SELECT COUNT(*) FROM f_relationships r WHERE EXISTS (SELECT 1 FROM f_blocks x WHERE x.migration_id = m.id AND x.id = r.source_block_id) OR EXISTS (SELECT 1 FROM f_blocks x WHERE x.migration_id = m.id AND x.id = r.target_block_id)) AS total_relationships
FROM f_migrations m LEFT JOIN f_blocks b ON b.migration_id = m.id GROUP BY m.id, m.repository_name, m.created_at""")
def v14_migration_quality(c):
    """An edge counts once for each migration that holds one of its ends."""
    home = c.blocks.select("id", "migration_id")
    r = c.relationships
    for end in ("source", "target"):
        r = r.join(home.select(col("id").alias(f"{end}_block_id"), col("migration_id").alias(end)), f"{end}_block_id", "left")
    edges = r.select(F.explode(F.array_distinct(F.array_compact(F.array("source", "target")))).alias("id")).groupBy("id").agg(F.count("*").alias("total_relationships"))
    files = c.containers.groupBy(col("migration_id").alias("id")).agg(F.count("*").alias("total_containers"))
    blocks = c.blocks.groupBy(col("migration_id").alias("id")).agg(F.count("*").alias("total_blocks"), F.count("semantic_name").alias("named_blocks"), F.round(F.avg("cc"), 6).alias("avg_complexity"))
    out = c.migrations.join(files, "id", "left").join(blocks, "id", "left").join(edges, "id", "left").fillna(0, ["total_containers", "total_blocks", "named_blocks", "total_relationships"])
    return out.select(col("id").alias("migration_id"), "repository_name", "created_at", "total_containers", "total_blocks", "named_blocks", share(col("named_blocks"), col("total_blocks")).alias("semantic_coverage_percentage"), "avg_complexity", "total_relationships")


@query("""SELECT id, semantic_name, file_name, language, position FROM f_blocks WHERE block_type = 'Function' AND (raw_text ILIKE '%for%' OR raw_text ILIKE '%while%')
AND (raw_text ILIKE '%SELECT%' OR raw_text ILIKE '%INSERT%' OR raw_text ILIKE '%UPDATE%' OR raw_text ILIKE '%DELETE%' OR raw_text ILIKE '%query%' OR raw_text ILIKE '%execute%')""")
def v15_queries_in_loops(c):
    return c.blocks.where(function() & holds("raw_text", "for", "while") & holds("raw_text", "query", "execute", *WORDS)).select(*PLACE, "position")


@query("""SELECT id, semantic_name, file_name, language, position FROM f_blocks WHERE block_type = 'Function' AND NOT starts_with(lower(raw_text), 'async ') AND (raw_text ILIKE '%requests.get%' OR raw_text ILIKE '%requests.post%'
OR raw_text ILIKE '%urllib.request%' OR raw_text ILIKE '%file.read%' OR raw_text ILIKE '%open(%' OR raw_text ILIKE '%database%' OR raw_text ILIKE '%query%')""")
def v16_sync_operations(c):
    blocking = holds("raw_text", "requests.get", "requests.post", "urllib.request", "file.read", "open(", "database", "query")
    return c.blocks.where(function() & ~col("raw_text").ilike("async %") & blocking).select(*PLACE, "position")


@query("""SELECT b.id, b.semantic_name, b.block_type, b.file_name, b.language, b.position FROM f_blocks b WHERE b.block_type IN ('Function', 'Class')
AND b.id NOT IN (SELECT source_block_id FROM f_relationships) AND b.id NOT IN (SELECT target_block_id FROM f_relationships)""")
def v18_orphaned_blocks(c):
    ends = c.relationships.select(F.explode(F.array("source_block_id", "target_block_id")).alias("id"))
    return c.blocks.where(col("block_type").isin("Function", "Class")).join(ends, "id", "left_anti").select("id", "semantic_name", "block_type", "file_name", "language", "position")


@query("""SELECT id, semantic_name, file_name, language, position, CASE WHEN raw_text ILIKE '%@app.route%' THEN 'Flask' WHEN raw_text ILIKE '%@router%' THEN 'FastAPI' WHEN raw_text ILIKE '%express%' THEN 'Express.js' WHEN raw_text ILIKE '%Controller%' THEN 'MVC Controller' ELSE 'Unknown' END AS framework,
CASE WHEN raw_text ILIKE '%GET%' THEN 'GET' WHEN raw_text ILIKE '%POST%' THEN 'POST' WHEN raw_text ILIKE '%PUT%' THEN 'PUT' WHEN raw_text ILIKE '%DELETE%' THEN 'DELETE' ELSE 'Unknown' END AS http_method
FROM f_blocks WHERE block_type = 'Function' AND (semantic_name ILIKE '%Controller%' OR semantic_name ILIKE '%Route%' OR semantic_name ILIKE '%Handler%' OR semantic_name ILIKE '%endpoint%' OR raw_text ILIKE '%@app.route%' OR raw_text ILIKE '%@router%' OR raw_text ILIKE '%express%')""")
def v19_api_endpoints(c):
    framework = first_match(*((holds("raw_text", x), name) for x, name in (("@app.route", "Flask"), ("@router", "FastAPI"), ("express", "Express.js"), ("controller", "MVC Controller"))), other="Unknown")
    method = first_match(*((holds("raw_text", x), x) for x in ("GET", "POST", "PUT", "DELETE")), other="Unknown")
    serves = holds("semantic_name", "controller", "route", "handler", "endpoint") | holds("raw_text", "@app.route", "@router", "express")
    return c.blocks.where(function() & serves).select(*PLACE, "position", framework.alias("framework"), method.alias("http_method"))


@query("""SELECT b.container_id, b.file_name, b.language, COUNT(b.id) AS total_functions, COUNT(r.target_block_id) AS tested_functions, ROUND(100 * COUNT(r.target_block_id)::DOUBLE / NULLIF(COUNT(b.id), 0), 2) AS coverage_percentage
FROM f_blocks b LEFT JOIN (SELECT DISTINCT target_block_id FROM f_relationships WHERE relationship_type = 'tests') r ON b.id = r.target_block_id WHERE b.block_type = 'Function' GROUP BY b.container_id, b.file_name, b.language""")
def v20_coverage_by_file(c):
    """A function counts once, however many tests reach it."""
    files = flagged_tested(c).where(function()).groupBy("container_id", "file_name", "language").agg(F.count("*").alias("total_functions"), F.count("has_test").alias("tested_functions"))
    return files.withColumn("coverage_percentage", share(col("tested_functions"), col("total_functions"), 2))


@query("""SELECT container_id AS id, file_name, language, COUNT(*) AS test_count, array_to_string(list_sort(array_agg(COALESCE(semantic_name, ''))), ',') AS test_names FROM f_blocks WHERE block_type = 'Function'
AND (file_name ILIKE '%test%' OR file_name ILIKE '%spec%' OR semantic_name ILIKE 'test_%' OR semantic_name ILIKE '%_test' OR semantic_name ILIKE 'it_%' OR semantic_name ILIKE 'describe_%') GROUP BY container_id, file_name, language""")
def v21_test_files(c):
    by_name = reduce(or_, (col("semantic_name").ilike(p) for p in ("test_%", "%_test", "it_%", "describe_%")))
    found = c.blocks.where(function() & (holds("file_name", "test", "spec") | by_name)).groupBy(col("container_id").alias("id"), "file_name", "language")
    return found.agg(F.count("*").alias("test_count"), F.array_join(F.array_sort(F.collect_list(F.coalesce("semantic_name", F.lit("")))), ",").alias("test_names"))


@query("""SELECT COUNT(DISTINCT container_id) AS total_files, COUNT(DISTINCT language) AS languages_count, COUNT(*) AS total_blocks, COUNT(CASE WHEN block_type = 'Function' THEN 1 END) AS total_functions, COUNT(CASE WHEN block_type = 'Class' THEN 1 END) AS total_classes,
COUNT(CASE WHEN block_type = 'Interface' THEN 1 END) AS total_interfaces, ROUND(AVG(cc), 2) AS avg_complexity, MAX(cc) AS max_complexity, (SELECT COUNT(*) FROM f_relationships WHERE source_block_id IN (SELECT id FROM f_blocks)) AS total_relationships FROM f_blocks""")
def v22_codebase_statistics(c):
    edges = c.relationships.join(c.blocks.select(col("id").alias("source_block_id")), "source_block_id", "left_semi").agg(F.count("*").alias("total_relationships"))
    one = c.blocks.agg(F.countDistinct("container_id").alias("total_files"), F.countDistinct("language").alias("languages_count"), F.count("*").alias("total_blocks"), many("Function").alias("total_functions"), many("Class").alias("total_classes"), many("Interface").alias("total_interfaces"), F.round(F.avg("cc"), 2).alias("avg_complexity"), F.max("cc").alias("max_complexity"))
    return one.join(edges, F.lit(True))  # one row each


@query("""SELECT b.language, COUNT(DISTINCT b.container_id) AS files_count, COUNT(*) AS blocks_count, COUNT(CASE WHEN b.block_type = 'Function' THEN 1 END) AS functions_count, COUNT(CASE WHEN b.block_type = 'Class' THEN 1 END) AS classes_count, ROUND(AVG(b.cc), 2) AS avg_complexity,
COUNT(CASE WHEN b.block_type = 'Function' AND b.id NOT IN (SELECT target_block_id FROM f_relationships WHERE relationship_type = 'tests') THEN 1 END) AS untested_functions FROM f_blocks b WHERE b.language IS NOT NULL GROUP BY b.language""")
def v23_language_statistics_2(c):
    known = flagged_tested(c).where("language IS NOT NULL").groupBy("language")
    return known.agg(F.countDistinct("container_id").alias("files_count"), F.count("*").alias("blocks_count"), many("Function").alias("functions_count"), many("Class").alias("classes_count"), F.round(F.avg("cc"), 2).alias("avg_complexity"), F.count(when(function() & col("has_test").isNull(), 1)).alias("untested_functions"))


@query("""SELECT c.id, c.name, c.language, COUNT(b.id) AS block_count, COALESCE(ROUND(AVG(CASE WHEN b.id IS NULL THEN NULL WHEN b.language_features IS NOT NULL THEN 1.0::DOUBLE WHEN b.body_ast IS NOT NULL THEN 0.8::DOUBLE WHEN b.raw_text <> '' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END), 6), 0.0) AS semantic_completeness_score,
COALESCE(array_to_string(list_sort(array_agg(DISTINCT b.block_type) FILTER (b.block_type IS NOT NULL)), ','), '') AS block_types FROM f_containers c LEFT JOIN f_raw b ON b.container_id = c.id GROUP BY c.id, c.name, c.language""")
def v24_container_completeness(c):
    level = when(col("language_features").isNotNull(), 1.0).when(col("body_ast").isNotNull(), 0.8).when(col("raw_text") != "", 0.6).otherwise(0.0)
    per = c.blocks.groupBy(col("container_id").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg(level), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("block_type")), ",").alias("types"))
    out = c.containers.select("id", "name", "language").join(per, "id", "left")
    return out.select("id", "name", "language", F.coalesce("n", F.lit(0)).alias("block_count"), F.coalesce("score", F.lit(0.0)).alias("semantic_completeness_score"), F.coalesce("types", F.lit("")).alias("block_types"))


@query("""SELECT b.id, b.block_type, b.semantic_name, b.position, (SELECT COUNT(*) FROM f_relationships r WHERE r.source_block_id = b.id) AS outgoing_relationships, (SELECT COUNT(*) FROM f_relationships r WHERE r.target_block_id = b.id) AS incoming_relationships FROM f_blocks b""")
def v25_complete_blocks(c):
    """Counts of each side by itself; the two do not multiply."""
    ends = c.relationships.select(F.explode(F.array(F.struct(col("source_block_id").alias("id"), F.lit(1).alias("o")), F.struct(col("target_block_id").alias("id"), F.lit(0).alias("o")))).alias("x"))
    n = ends.groupBy("x.id").agg(F.sum("x.o").alias("outgoing_relationships"), F.sum(1 - col("x.o")).alias("incoming_relationships"))
    return c.blocks.select("id", "block_type", "semantic_name", "position").join(n, "id", "left").fillna(0, ["outgoing_relationships", "incoming_relationships"])


@query("""WITH RECURSIVE tree AS (SELECT id, container_id, block_type, semantic_name, parent_block_id, CAST(id AS VARCHAR) AS path, 0 AS level FROM f_blocks WHERE parent_block_id IS NULL
UNION ALL SELECT b.id, b.container_id, b.block_type, b.semantic_name, b.parent_block_id, t.path || '/' || CAST(b.id AS VARCHAR), t.level + 1 FROM f_blocks b JOIN tree t ON b.parent_block_id = t.id) SELECT * FROM tree""")
def v26_block_hierarchy(c):
    """Paths grow by doubling: each block looks up what its topmost known ancestor knows, until all begin at a root."""
    from codequarry.plans.lineage import written

    own = c.blocks.select("id", "container_id", "block_type", "semantic_name", "parent_block_id")
    up = own.select("id", col("parent_block_id").alias("next"), text_of("id").alias("path"), F.lit(0).alias("level"))
    while True:
        up = written(up, "hierarchy")
        if up.where("next IS NOT NULL").isEmpty():
            break
        above = up.select(col("id").alias("next"), col("next").alias("further"), col("path").alias("before"), (col("level") + 1).alias("steps"))
        # a block whose next is unknown has no root and goes, as in the recursion from the roots
        on = up.where("next IS NOT NULL").join(above, "next").select("id", col("further").alias("next"), F.concat("before", F.lit("/"), "path").alias("path"), (col("level") + col("steps")).alias("level"))
        up = up.where("next IS NULL").unionByName(on)
    return own.join(up.select("id", "path", "level"), "id")


def text_of(name: str) -> Column:
    return col(name).cast("string")


@query("""SELECT b.id, LEAST(100, 4 * COALESCE(b.cc, 0) + 3 * (SELECT COUNT(*) FROM f_relationships r WHERE r.source_block_id = b.id) + GREATEST(0, 30 - 10 * (SELECT COUNT(*) FROM f_relationships r WHERE r.target_block_id = b.id AND r.relationship_type = 'tests'))) AS debt FROM f_blocks b""")
def f01_technical_debt(c):
    is_test = (col("relationship_type") == "tests").cast("int")
    ends = c.relationships.select(F.explode(F.array(F.struct(col("source_block_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("t")), F.struct(col("target_block_id").alias("id"), F.lit(0).alias("o"), is_test.alias("t")))).alias("x"))
    n = ends.groupBy("x.id").agg(F.sum("x.o").alias("o"), F.sum("x.t").alias("t"))
    count = lambda k: F.coalesce(k, F.lit(0))
    return c.blocks.select("id", "cc").join(n, "id", "left").select("id", F.least(F.lit(100), 4 * count("cc") + 3 * count("o") + F.greatest(F.lit(0), 30 - 10 * count("t"))).alias("debt"))


@query("""WITH x AS (SELECT b.container_id, COUNT(CASE WHEN block_type = 'Function' THEN 1 END) AS n, AVG(cc) AS avg, COUNT(CASE WHEN block_type = 'Function' AND t.k IS NULL THEN 1 END) AS u FROM f_blocks b LEFT JOIN (SELECT DISTINCT target_block_id AS k FROM f_relationships WHERE relationship_type = 'tests') t ON t.k = b.id GROUP BY b.container_id)
SELECT container_id, 'Average Complexity' AS metric_name, ROUND(COALESCE(avg, 0), 6) AS metric_value, CASE WHEN avg <= 5 THEN 'Good' WHEN avg <= 10 THEN 'Warning' ELSE 'Critical' END AS status,
CASE WHEN avg <= 5 THEN 'Complexity is within acceptable range' WHEN avg <= 10 THEN 'Consider refactoring complex functions' ELSE 'High complexity detected - refactoring recommended' END AS recommendation FROM x
UNION ALL SELECT container_id, 'Test Coverage', CASE WHEN n > 0 THEN ROUND(100 * (n - u)::DOUBLE / n, 2) ELSE 0 END, CASE WHEN n = 0 THEN 'N/A' WHEN u = 0 THEN 'Excellent' WHEN u::DOUBLE / n <= 0.2 THEN 'Good' WHEN u::DOUBLE / n <= 0.5 THEN 'Warning' ELSE 'Critical' END,
CASE WHEN n = 0 THEN 'No functions to test' WHEN u = 0 THEN 'All functions have tests' ELSE 'Add tests for ' || u || ' functions' END FROM x""")
def f04_file_quality(c):
    """Both metrics of every file, from one aggregate."""
    x = flagged_tested(c).groupBy("container_id").agg(F.count(when(function(), 1)).alias("n"), F.avg("cc").alias("a"), F.count(when(function() & col("has_test").isNull(), 1)).alias("u"))
    a, n, u = col("a"), col("n"), col("u")
    rated = F.struct(
        F.lit("Average Complexity").alias("metric_name"), F.round(F.coalesce(a, F.lit(0.0)), 6).alias("metric_value"), first_match((a <= 5, "Good"), (a <= 10, "Warning"), other="Critical").alias("status"),
        first_match((a <= 5, "Complexity is within acceptable range"), (a <= 10, "Consider refactoring complex functions"), other="High complexity detected - refactoring recommended").alias("recommendation"),
    )
    covered = F.struct(
        F.lit("Test Coverage").alias("metric_name"), F.when(n > 0, F.round(100 * (n - u) / n, 2)).otherwise(0.0).alias("metric_value"),
        first_match((n == 0, "N/A"), (u == 0, "Excellent"), (u / n <= 0.2, "Good"), (u / n <= 0.5, "Warning"), other="Critical").alias("status"),
        when(n == 0, "No functions to test").when(u == 0, "All functions have tests").otherwise(F.concat(F.lit("Add tests for "), u.cast("string"), F.lit(" functions"))).alias("recommendation"),
    )
    return x.select("container_id", F.inline(F.array(rated, covered)))


SPLIT = r"[^a-z0-9]+"


def search(c: Code, term: str, language: str | None = None, block_type: str | None = None, limit: int = 100) -> DataFrame:
    """Blocks whose name or text holds every word of term; rank: their occurrences among all words. Best first."""
    words = [w for w in __import__("re").split(SPLIT, term.lower()) if w]
    own = F.array_remove(F.split(F.lower(F.concat_ws(" ", F.coalesce("semantic_name", F.lit("")), F.coalesce("raw_text", F.lit("")))), SPLIT), "")
    found = c.blocks.where(F.lit(True) if language is None else col("language") == language).where(F.lit(True) if block_type is None else col("block_type") == block_type).withColumn("words", own)
    found = found.where(reduce(and_, (F.array_contains("words", w) for w in words), F.lit(bool(words))))
    rank = F.size(F.filter("words", lambda w: w.isin(words))) / F.size("words")
    return found.select("id", "semantic_name", "block_type", "file_name", "language", "position", F.round(rank, 6).alias("relevance_score")).orderBy(F.desc("relevance_score"), "id").limit(limit)


FOUND = """SELECT id, semantic_name, block_type, file_name, language, position, ROUND(len(list_filter(w, lambda x: x IN ('query', 'c')))::DOUBLE / len(w), 6) AS relevance_score FROM
(SELECT *, list_filter(regexp_split_to_array(lower(COALESCE(semantic_name, '') || ' ' || COALESCE(raw_text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM f_blocks) WHERE list_contains(w, 'query') AND list_contains(w, 'c')"""


@query(FOUND + " AND language = 'rust' AND block_type = 'Function' ORDER BY relevance_score DESC, id LIMIT 100")
def f03_search_blocks(c):
    return search(c, "query(c)", "rust", "Function")


@query(FOUND + " ORDER BY relevance_score DESC, id LIMIT 20")
def r06_search_blocks(c):
    return search(c, "Query c", limit=20)
