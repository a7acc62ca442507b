"""Aggregates, searches and chart data over a project: files are containers, elements are blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.graph import file_edges
from codequarry.operators.screens import first_match, many
from codequarry.plans.registry import query
from codequarry.sources.code import Code

col = F.col
TYPES = ("Class", "Function", "Import", "Interface", "Module", "Variable")


def files(c: Code) -> DataFrame:
    """By file: path, language, lines, classes, functions, imports, complexity."""
    made = c.blocks.groupBy("container_id", "original_path", "language")
    return made.agg(F.sum("loc").alias("lines"), many("Class").alias("n_classes"), many("Function").alias("n_functions"), many("Import").alias("n_imports"), F.round(F.coalesce(F.avg("cc"), F.lit(0.0)), 6).alias("complexity"))


FILES = "files AS (SELECT container_id, original_path, language, SUM(loc) AS lines, COUNT(CASE WHEN block_type = 'Class' THEN 1 END) AS n_classes, COUNT(CASE WHEN block_type = 'Function' THEN 1 END) AS n_functions, COUNT(CASE WHEN block_type = 'Import' THEN 1 END) AS n_imports, ROUND(COALESCE(AVG(cc), 0), 6) AS complexity FROM f_blocks GROUP BY 1, 2, 3)"


@query(f"""WITH {FILES} SELECT COUNT(*) AS total_files, SUM(lines) AS total_lines, SUM(n_classes) AS total_classes, SUM(n_functions) AS total_functions, ROUND(AVG(CASE WHEN complexity > 0 THEN complexity END), 5) AS average_complexity,
COUNT(CASE WHEN lines < 100 THEN 1 END) AS small_files, COUNT(CASE WHEN lines >= 100 AND lines < 500 THEN 1 END) AS medium_files, COUNT(CASE WHEN lines >= 500 THEN 1 END) AS large_files FROM files""")
def p01_repository_summary(c):
    lines = col("lines")
    return files(c).agg(
        F.count("*").alias("total_files"), F.sum("lines").alias("total_lines"), F.sum("n_classes").alias("total_classes"), F.sum("n_functions").alias("total_functions"), F.round(F.avg(F.when(col("complexity") > 0, col("complexity"))), 5).alias("average_complexity"),
        F.count_if(lines < 100).alias("small_files"), F.count_if((lines >= 100) & (lines < 500)).alias("medium_files"), F.count_if(lines >= 500).alias("large_files"),
    )


@query("SELECT DISTINCT semantic_name AS name FROM f_blocks WHERE block_type = 'Import' AND semantic_name IS NOT NULL ORDER BY name LIMIT 100")
def p01_imports(c):
    """The first 100 distinct imports."""
    return c.blocks.where("block_type = 'Import' AND semantic_name IS NOT NULL").select(col("semantic_name").alias("name")).distinct().orderBy("name").limit(100)


def top(c: Code, by: str, kind: str) -> DataFrame:
    return files(c).select(F.lit(kind).alias("list"), "container_id", col(by).cast("double").alias("value")).orderBy(F.desc("value"), "container_id").limit(10)


@query(f"""WITH {FILES} SELECT * FROM (SELECT 'complexity' AS list, container_id, complexity::DOUBLE AS value FROM files ORDER BY value DESC, container_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'lines', container_id, lines::DOUBLE AS value FROM files ORDER BY value DESC, container_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'imports', container_id, n_imports::DOUBLE AS value FROM files ORDER BY value DESC, container_id LIMIT 10)""")
def p02_top_files(c):
    """Ties by id."""
    return top(c, "complexity", "complexity").unionByName(top(c, "lines", "lines")).unionByName(top(c, "n_imports", "imports"))


@query("""SELECT regexp_replace(original_path, '/[^/]*$', '') AS directory, COUNT(*) AS n_files, bool_or(contains(name, 'test_')) AS has_tests, COUNT(CASE WHEN language = 'python' THEN 1 END) > 0 OR COUNT(CASE WHEN language = 'rust' THEN 1 END) > 0 AS is_package FROM f_containers GROUP BY 1""")
def p03_packages(c):
    """Directories: a package holds Python or Rust files."""
    directory = F.regexp_replace("original_path", "/[^/]*$", "")
    return c.containers.groupBy(directory.alias("directory")).agg(F.count("*").alias("n_files"), F.bool_or(col("name").contains("test_")).alias("has_tests"), ((F.count_if(col("language") == "python") > 0) | (F.count_if(col("language") == "rust") > 0)).alias("is_package"))


def markers(name: Column) -> Column:
    """The kind of package that the file names of a directory (an aggregate) make: null if none."""
    has = lambda *names: F.bool_or(name.isin(*names))
    n = lambda end: F.count_if(name.endswith(end))
    return first_match((has("__init__.py"), "python"), (has("package.json", "index.js", "index.ts"), "javascript"), (has("go.mod") | (n(".go") > 0), "go"), (has("Cargo.toml", "lib.rs", "main.rs"), "rust"), (n(".java") >= 2, "java"))


@query("""SELECT id, CASE WHEN block_type = 'Function' AND EXISTS (SELECT 1 FROM f_blocks x WHERE x.container_id = b.container_id AND x.block_type = 'Class') THEN 'METHOD' ELSE upper(block_type) END AS element_type,
CASE WHEN block_type = 'Function' THEN (SELECT MIN(x.id) FROM f_blocks x WHERE x.container_id = b.container_id AND x.block_type = 'Class') END AS parent_id FROM f_blocks b WHERE block_type IN ('Class', 'Function', 'Variable')""")
def p04_elements(c):
    """Classes, functions and variables; functions are methods of the file's first class if it has one."""
    first = c.blocks.where("block_type = 'Class'").groupBy("container_id").agg(F.min("id").alias("parent"))
    is_function = col("block_type") == "Function"
    own = c.blocks.where(col("block_type").isin("Class", "Function", "Variable")).join(first, "container_id", "left")
    return own.select("id", F.when(is_function & col("parent").isNotNull(), "METHOD").otherwise(F.upper("block_type")).alias("element_type"), F.when(is_function, col("parent")).alias("parent_id"))


@query(f"WITH {FILES} SELECT regexp_replace(original_path, '/[^/]*$', '') AS package, SUM(lines) AS lines_of_code, ROUND(AVG(NULLIF(complexity, 0)), 5) AS complexity FROM files GROUP BY 1")
def p05_package_metrics(c):
    """Lines of a package's files and the mean of their complexities, those of 0 left out."""
    return files(c).groupBy(F.regexp_replace("original_path", "/[^/]*$", "").alias("package")).agg(F.sum("lines").alias("lines_of_code"), F.round(F.avg(F.nullif("complexity", F.lit(0.0))), 5).alias("complexity"))


@query("SELECT COUNT(*) AS total_elements, COUNT(DISTINCT language) AS languages, SUM(loc) AS lines_of_code, ROUND(AVG(COALESCE(cc, 0)), 6) AS average_complexity, COUNT(CASE WHEN block_type = 'Function' THEN 1 END) AS functions, COUNT(CASE WHEN block_type = 'Class' THEN 1 END) AS classes FROM f_blocks")
def p06_project_metrics(c):
    return c.blocks.agg(F.count("*").alias("total_elements"), F.countDistinct("language").alias("languages"), F.sum("loc").alias("lines_of_code"), F.round(F.avg(F.coalesce("cc", F.lit(0))), 6).alias("average_complexity"), many("Function").alias("functions"), many("Class").alias("classes"))


@query("SELECT ROUND(AVG(cc), 6) AS average, MAX(cc) AS max, MIN(cc) AS min, COUNT(*) AS total_elements, COUNT(CASE WHEN cc <= 5 THEN 1 END) AS low, COUNT(CASE WHEN cc > 5 AND cc <= 10 THEN 1 END) AS medium, COUNT(CASE WHEN cc > 10 AND cc <= 20 THEN 1 END) AS high, COUNT(CASE WHEN cc > 20 THEN 1 END) AS very_high FROM f_blocks WHERE cc > 0")
def p07_complexity_stats(c):
    cc = col("cc")
    return c.blocks.where("cc > 0").agg(F.round(F.avg("cc"), 6).alias("average"), F.max("cc").alias("max"), F.min("cc").alias("min"), F.count("*").alias("total_elements"), F.count_if(cc <= 5).alias("low"), F.count_if((cc > 5) & (cc <= 10)).alias("medium"), F.count_if((cc > 10) & (cc <= 20)).alias("high"), F.count_if(cc > 20).alias("very_high"))


@query("SELECT COUNT(*) AS total_dependencies, COUNT(DISTINCT source_block_id) AS elements_with_dependencies, ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM f_blocks), 6) AS average_dependencies, ROUND(COUNT(DISTINCT source_block_id)::DOUBLE / (SELECT COUNT(*) FROM f_blocks), 6) AS density FROM (SELECT DISTINCT source_block_id, target_block_id FROM f_relationships)")
def p08_dependency_stats(c):
    n = c.blocks.agg(F.count("*").alias("n"))
    own = c.edges().agg(F.count("*").alias("total_dependencies"), F.countDistinct("s").alias("elements_with_dependencies")).join(F.broadcast(n), F.lit(True))  # one row
    return own.select("total_dependencies", "elements_with_dependencies", F.round(col("total_dependencies") / col("n"), 6).alias("average_dependencies"), F.round(col("elements_with_dependencies") / col("n"), 6).alias("density"))


@query("SELECT language, COUNT(*) AS total_elements, SUM(loc) AS lines_of_code, ROUND(AVG(COALESCE(cc, 0)), 6) AS average_complexity, " + ", ".join(f"COUNT(CASE WHEN block_type = '{t}' THEN 1 END) AS {t.lower()}" for t in TYPES) + " FROM f_blocks WHERE language IS NOT NULL GROUP BY language")
def p09_language_breakdown(c):
    return c.blocks.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("total_elements"), F.sum("loc").alias("lines_of_code"), F.round(F.avg(F.coalesce("cc", F.lit(0))), 6).alias("average_complexity"), *(many(t).alias(t.lower()) for t in TYPES))


@query("SELECT CASE WHEN COALESCE(cc, 0) <= 5 THEN 'low' WHEN cc <= 10 THEN 'medium' WHEN cc <= 20 THEN 'high' ELSE 'very_high' END AS band, COUNT(*) AS n, ROUND(AVG(param_count), 6) AS mean_parameters FROM f_blocks WHERE block_type = 'Function' GROUP BY 1")
def p10_function_metrics(c):
    """Functions by complexity, null as 0."""
    cc = F.coalesce("cc", F.lit(0))
    band = first_match((cc <= 5, "low"), (cc <= 10, "medium"), (cc <= 20, "high"), other="very_high")
    return c.blocks.where("block_type = 'Function'").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(F.size(F.split("parameters", ","))), 6).alias("mean_parameters"))


@query("SELECT language, block_type, COUNT(*) AS n FROM f_blocks GROUP BY language, block_type")
def p11_types_by_language(c):
    return c.blocks.groupBy("language", "block_type").agg(F.count("*").alias("n"))


@query("SELECT b.id, b.semantic_name, b.block_type, b.file_name, b.cc AS complexity, p.semantic_name AS parent_name, (SELECT COUNT(*) FROM f_blocks x WHERE x.parent_block_id = b.id) AS n_children FROM f_blocks b LEFT JOIN f_blocks p ON p.id = b.parent_block_id WHERE b.block_type IN ('Class', 'Function')")
def p12_element_details(c):
    """The detail view of every class and function: parent and number of children."""
    parent = c.blocks.select(col("id").alias("parent_block_id"), col("semantic_name").alias("parent_name"))
    children = c.blocks.where("parent_block_id IS NOT NULL").groupBy(col("parent_block_id").alias("id")).agg(F.count("*").alias("n_children"))
    own = c.blocks.where(col("block_type").isin("Class", "Function")).join(parent, "parent_block_id", "left").join(children, "id", "left").fillna(0, ["n_children"])
    return own.select("id", "semantic_name", "block_type", "file_name", col("cc").alias("complexity"), "parent_name", "n_children")


@query("SELECT id, semantic_name, block_type, language FROM f_blocks WHERE contains(lower(semantic_name), 'factory') AND block_type = 'Class' AND language = 'python'")
def p15_search_elements(c):
    return search(c.blocks, "Factory", "Class", "python").select("id", "semantic_name", "block_type", "language")


def search(df: DataFrame, text: str, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Elements whose name holds text, in either case, of a type and a language if given."""
    if not 0 < len(text) <= 100:
        raise ValueError("a query has 1 to 100 characters")
    found = df.where(F.lower("semantic_name").contains(text.lower()))
    found = found.where(col("block_type") == kind) if kind else found
    return found.where(col("language") == language) if language else found


@query("SELECT id, semantic_name, block_type FROM f_blocks WHERE contains(lower(COALESCE(semantic_name, '')), 'route') OR contains(lower(block_type), 'route') OR contains(lower(raw_text), 'route') ORDER BY id LIMIT 100")
def p16_search_nodes(c):
    hit = [F.coalesce(F.lower(k).contains("route"), F.lit(False)) for k in ("semantic_name", "block_type", "raw_text")]
    return c.blocks.where(hit[0] | hit[1] | hit[2]).select("id", "semantic_name", "block_type").orderBy("id").limit(100)


@query("""SELECT path, depth, COUNT(*) AS n_files FROM (SELECT array_to_string(string_split(original_path, '/')[1:d], '/') AS path, d AS depth FROM f_containers, (SELECT unnest([1, 2, 3]) AS d) WHERE d <= len(string_split(original_path, '/'))) GROUP BY path, depth""")
def p17_file_tree(c):
    """Every directory and file with the number of files at or under it."""
    parts = F.split("original_path", "/")
    nodes = F.transform(parts, lambda x, i: F.struct(F.array_join(F.slice(parts, 1, i + 1), "/").alias("path"), (i + 1).alias("depth")))
    return c.containers.select(F.inline(nodes)).groupBy("path", "depth").agg(F.count("*").alias("n_files"))


@query(f"WITH {FILES}, fe AS (SELECT DISTINCT a.container_id AS s, b.container_id AS t FROM f_relationships r JOIN f_blocks a ON a.id = r.source_block_id JOIN f_blocks b ON b.id = r.target_block_id WHERE r.relationship_type IN ('calls', 'depends_on', 'imports') AND a.container_id <> b.container_id) SELECT 'node' AS kind, container_id AS a, NULL AS b, GREATEST(5, lines // 50) AS size FROM files UNION ALL SELECT 'edge', s, t, 1 FROM fe")
def p18_network(c):
    """Nodes and edges of the network and scatter charts; a node's size is max(5, lines / 50)."""
    size = F.greatest(F.lit(5).cast("long"), F.floor(col("lines") / 50))
    nodes = files(c).select(F.lit("node").alias("kind"), col("container_id").alias("a"), F.lit(None).cast("long").alias("b"), size.alias("size"))
    return nodes.unionByName(file_edges(c).select(F.lit("edge").alias("kind"), col("s").alias("a"), col("t").alias("b"), F.lit(1).cast("long").alias("size")))


@query(f"WITH {FILES} SELECT regexp_replace(original_path, '/[^/]*$', '') AS directory, string_agg(CAST(CAST(complexity AS DECIMAL(18, 2)) AS VARCHAR), ',' ORDER BY container_id) AS cells, COUNT(*) AS n FROM files GROUP BY 1")
def p19_heat_map(c):
    """Complexities of a directory's files, in order of their ids."""
    row = F.struct("container_id", F.format_string("%.2f", F.round("complexity", 2)).alias("x"))
    return files(c).groupBy(F.regexp_replace("original_path", "/[^/]*$", "").alias("directory")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]), ",").alias("cells"), F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT regexp_replace(original_path, '/[^/]*$', '') AS parent, language, SUM(lines) AS size, ROUND(AVG(complexity), 4) AS color FROM files GROUP BY 1, 2")
def p19_treemap(c):
    return files(c).groupBy(F.regexp_replace("original_path", "/[^/]*$", "").alias("parent"), "language").agg(F.sum("lines").alias("size"), F.round(F.avg("complexity"), 4).alias("color"))


@query(f"WITH {FILES} SELECT container_id, language, lines, n_classes, n_functions, n_imports, ROUND(complexity, 2) AS complexity, left(md5(original_path), 8) AS hash FROM files")
def x17_compact_files(c):
    return files(c).select("container_id", "language", "lines", "n_classes", "n_functions", "n_imports", F.round("complexity", 2).alias("complexity"), F.substring(F.md5(col("original_path").cast("binary")), 1, 8).alias("hash"))


@query("""WITH fn AS (SELECT * FROM f_blocks WHERE block_type = 'Function'), e AS (SELECT DISTINCT a.container_id, r.source_block_id AS s, r.target_block_id AS t FROM f_relationships r JOIN fn a ON a.id = r.source_block_id JOIN fn b ON b.id = r.target_block_id AND a.container_id = b.container_id WHERE r.relationship_type = 'calls')
SELECT container_id, 'digraph {' || string_agg('"' || s || '" -> "' || t || '";', ' ' ORDER BY s, t) || '}' AS dot FROM e GROUP BY container_id""")
def snk07_dot_graphs(c):
    """The call graph of every file as text."""
    from codequarry.operators.graph import calls

    edge = F.format_string('"%d" -> "%d";', col("s"), col("t"))
    row = F.struct("s", "t", edge.alias("x"))
    return calls(c).groupBy("container_id").agg(F.concat(F.lit("digraph {"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]), " "), F.lit("}")).alias("dot"))


@query("""SELECT relationship_type, COUNT(CASE WHEN block_type = 'Class' THEN 1 END) AS "Class", COUNT(CASE WHEN block_type = 'Function' THEN 1 END) AS "Function", COUNT(CASE WHEN block_type = 'Module' THEN 1 END) AS "Module" FROM f_relationships r JOIN f_blocks b ON b.id = r.target_block_id GROUP BY relationship_type""")
def snk07_dependency_matrix(c):
    """Relationship types against the types of their targets."""
    kind = c.blocks.select(col("id").alias("target_block_id"), "block_type")
    return c.relationships.join(kind, "target_block_id").groupBy("relationship_type").pivot("block_type", ["Class", "Function", "Module"]).count().fillna(0)


@query("""SELECT id, '{"id":' || id || ',"name":"' || name || '"' || CASE WHEN language IS NULL THEN '' ELSE ',"language":"' || language || '"' END || '}' AS json FROM f_containers""")
def snk06_json_export(c):
    return c.containers.select("id", F.to_json(F.struct("id", "name", "language")).alias("json"))
