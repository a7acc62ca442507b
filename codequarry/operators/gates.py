"""Readiness gates, block contexts, components and small text transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import source_text
from codequarry.operators.graph import facts, modifiers, union
from codequarry.operators.scores import QUALITY, counted, lines, rated, round_trips, syntax_problems
from codequarry.operators.screens import coupling, first_match, flagged_tested
from codequarry.operators.text import filled, nodes
from codequarry.plans.lineage import folder, written
from codequarry.plans.observed import Observed
from codequarry.plans.registry import query
from codequarry.sources import sinks
from codequarry.sources.code import Code
from codequarry.sources.snapshots import Snapshots

col = F.col

#: By language and kind of a syntax node: the type of block that it makes; any language's last.
BLOCK_TYPES = {
    ("python", "function_definition"): "Function", ("python", "class_definition"): "Class", ("python", "import_statement"): "Import", ("python", "import_from_statement"): "Import",
    ("javascript", "function_declaration"): "Function", ("javascript", "arrow_function"): "Function", ("javascript", "class_declaration"): "Class", ("javascript", "import_statement"): "Import", ("javascript", "export_statement"): "Export",
    ("typescript", "interface_declaration"): "Interface", ("typescript", "type_alias_declaration"): "TypeDef",
    ("rust", "function_item"): "Function", ("rust", "struct_item"): "Class", ("rust", "enum_item"): "Class", ("rust", "impl_item"): "Class", ("rust", "trait_item"): "Interface", ("rust", "macro_definition"): "Function", ("rust", "use_declaration"): "Import", ("rust", "mod_item"): "Module",
    ("", "if_statement"): "Conditional", ("", "if_expression"): "Conditional", ("", "for_statement"): "Loop", ("", "while_statement"): "Loop", ("", "loop_expression"): "Loop", ("", "try_statement"): "TryCatch", ("", "try_expression"): "TryCatch",
}


def block_type_of(language: Column, kind: Column) -> Column:
    """The type of block of a syntax node, null if it makes none. TypeScript has all of JavaScript's."""
    table = {f"{a}|{b}": t for (a, b), t in BLOCK_TYPES.items()}
    look = lambda of: source_text.mapped(F.concat_ws("|", of, kind), table)
    script = language.isin("javascript", "typescript", "tsx")
    return F.coalesce(look(language), F.when(script, look(F.lit("javascript"))), F.when(language == "tsx", look(F.lit("typescript"))), look(F.lit("")))


@query("""SELECT path, position, CASE WHEN kind IN ('if_statement', 'if_expression') THEN 'Conditional' WHEN language IN ('javascript', 'typescript') AND kind = 'class_declaration' OR kind = 'impl_item' THEN 'Class' WHEN language IN ('javascript', 'typescript') AND kind = 'function_declaration' OR kind = 'function_item' THEN 'Function'
ELSE 'Import' END AS block_type FROM f_nodes WHERE slot = 'branch' OR language = 'rust' OR language IN ('javascript', 'typescript') AND slot <> 'member'""")
def ext02_block_types(c):
    """Of the syntax nodes of files, those that make a block."""
    own = nodes(c).join(c.files.select("path", "language"), "path")
    return own.select("path", "position", block_type_of(col("language"), col("kind")).alias("block_type")).where("block_type IS NOT NULL")


def statement_complexity(statements: Column) -> Column:
    """1, and for every statement 1 for if, 2 for a loop, 1 for try and 1 for with."""
    point = lambda s, n, *parts: F.when(source_text.any_of(s, parts), n).otherwise(0)
    one = lambda s: point(s, 1, "if ", "elif ") + point(s, 2, "for ", "while ") + point(s, 1, "try:", "except ") + point(s, 1, "with ")
    return F.aggregate(F.transform(statements, one), F.lit(1), lambda a, b: a + b)


@query("SELECT id, 1 + CASE WHEN contains(raw_text, 'if ') THEN 1 ELSE 0 END + CASE WHEN contains(raw_text, 'for ') THEN 2 ELSE 0 END AS complexity FROM f_blocks WHERE block_type = 'Function'")
def ext25_statement_complexity(c):
    return c.blocks.where("block_type = 'Function'").select("id", statement_complexity(lines("raw_text")).alias("complexity"))


@query("""WITH RECURSIVE up AS (SELECT id, id AS above FROM f_blocks UNION ALL SELECT up.id, b.parent_block_id FROM up JOIN f_blocks b ON b.id = up.above WHERE b.parent_block_id IS NOT NULL)
SELECT up.above AS id, SUM(COALESCE(b.cc, 0)) AS total_complexity FROM up JOIN f_blocks b ON b.id = up.id GROUP BY up.above""")
def ext26_total_complexity(c):
    """A block's complexity and that of all below it."""
    from codequarry.operators.screens import v26_block_hierarchy

    above = v26_block_hierarchy(c).select("id", F.explode(F.split("path", "/")).alias("above"))
    return above.join(c.blocks.select("id", "cc"), "id").groupBy(col("above").cast("long").alias("id")).agg(F.sum(F.coalesce("cc", F.lit(0))).alias("total_complexity"))


@query("""SELECT b.migration_id, COUNT(*) AS n_nodes, SUM(n) AS n_edges, ROUND(SUM(n)::DOUBLE / COUNT(*), 6) AS mean_coupling FROM (SELECT migration_id, (SELECT COUNT(*) FROM f_relationships r WHERE r.source_block_id = b.id) AS n FROM f_blocks b) b GROUP BY b.migration_id""")
def g16_graph_metrics(c):
    n = c.relationships.groupBy(col("source_block_id").alias("id")).agg(F.count("*").alias("n"))
    own = c.blocks.select("id", "migration_id").join(n, "id", "left").groupBy("migration_id")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return own.agg(F.count("*").alias("n_nodes"), total.alias("n_edges"), F.round(total / F.count("*"), 6).alias("mean_coupling"))


@query("SELECT i.id AS import_id, e.id AS element_id FROM f_blocks i JOIN f_blocks e ON i.semantic_name = e.semantic_name WHERE i.block_type = 'Import' AND e.block_type <> 'Import'")
def g38_import_dependencies(c):
    """Every element of an import's name."""
    own = c.own_blocks.where("semantic_name IS NOT NULL").select("id", "container_id", "semantic_name", "block_type").join(c.containers.select(col("id").alias("container_id")), "container_id", "left_semi")
    side = lambda kind, name: own.where(kind).select(col("id").alias(name), "semantic_name")
    return same_name(side("block_type = 'Import'", "import_id"), side("block_type <> 'Import'", "element_id"))


def same_name(imports: DataFrame, elements: DataFrame, most: int = 1024) -> DataFrame:
    """import_id and element_id of all pairs of one semantic_name. A name's imports are dealt to blocks of about `most`; every element meets each block of its name once. So no task
    gets a name whole, and the rows of a block repeat the same imports element by element, which writers compress well."""
    blocks = imports.groupBy("semantic_name").agg(F.ceil(F.count("*") / most).alias("blocks"))
    held = imports.join(blocks, "semantic_name").withColumn("block", F.pmod(F.xxhash64("import_id"), col("blocks"))).groupBy("semantic_name", "block").agg(F.sort_array(F.collect_list("import_id")).alias("ids"))
    each = elements.join(blocks, "semantic_name").select("element_id", "semantic_name", F.explode(F.sequence(F.lit(0).cast("long"), col("blocks") - 1)).alias("block"))
    return each.join(held.hint("merge"), ["semantic_name", "block"]).select(F.explode("ids").alias("import_id"), "element_id")


def import_graph(files: DataFrame) -> DataFrame:
    """Of files (path, imports): stem and dependency, another file's stem that an import or its first dotted part names."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    own = files.select(stem.alias("stem"), F.explode("imports").alias("imported"))
    stems = files.select(stem.alias("dependency")).distinct()
    whole = own.join(stems, own["imported"] == stems["dependency"])
    first = own.where(col("imported").contains(".")).join(stems, col("imported") == col("dependency"), "left_anti")
    part = first.join(stems, F.split("imported", r"\.")[0] == stems["dependency"])
    return whole.select("stem", "dependency").unionByName(part.select("stem", "dependency")).distinct()


@query("SELECT DISTINCT 'm' || (o_orderkey % 50) AS stem, 'm' || (o_custkey % 70) AS dependency FROM orders WHERE o_custkey % 70 < 50")
def g36_import_graph(c):
    """Orders as files of fifty stems: each imports one module by its name or by a dotted part of it."""
    n, m = (col("o_orderkey") % 50).cast("string"), (col("o_custkey") % 70).cast("string")
    name = F.concat(F.lit("m"), m, F.when(col("o_orderkey") % 2 == 0, ".part").otherwise(""))
    return import_graph(c.table("orders").select(F.concat(F.lit("src/m"), n, F.lit(".py")).alias("path"), F.array(name).alias("imports")))


@query("SELECT id, CASE block_type WHEN 'Function' THEN n_params WHEN 'Class' THEN 1 WHEN 'Variable' THEN 1 WHEN 'Import' THEN 1 ELSE 0 END AS complexity, COALESCE(semantic_name, '') <> '' OR block_type NOT IN ('Function', 'Class', 'Variable', 'Import') AS ready FROM f_blocks")
def q21_components(c):
    """Complexity of a block as a component of its kind, and whether it can be generated from."""
    kind = col("block_type")
    weight = F.when(kind == "Function", col("n_params")).when(kind.isin("Class", "Variable", "Import"), 1).otherwise(0)
    return c.blocks.select("id", weight.alias("complexity"), ((F.coalesce("semantic_name", F.lit("")) != "") | ~kind.isin("Function", "Class", "Variable", "Import")).alias("ready"))


@query(f"""WITH p AS (SELECT path AS id, a, b FROM f_rebuilt), {QUALITY} SELECT path, quality, NOT (contains(b, 'def ') AND NOT contains(b, ':')) AND quality >= 0.7 AS success FROM f_rebuilt JOIN q ON q.id = path""")
def q23_pipeline_success(c):
    """Of every Python file: the quality of the text generated from its blocks, and whether that is 0.7 and the text without syntax errors."""
    errors, _ = syntax_problems(col("b"), F.lit("python"))
    trips = round_trips(c, *counted(), col("kept"), (errors == 0).alias("clean")).withColumn("quality", rated(col("kept")))
    return trips.select("path", "quality", (col("clean") & (col("quality") >= 0.7)).alias("success"))


@query("SELECT id, 'Describe ' || COALESCE(semantic_name, 'unnamed') || ' in ' || file_name || ': ' || raw_text AS prompt, CASE WHEN COALESCE(cc, 0) > 30 THEN 'large' ELSE 'small' END AS provider FROM f_blocks WHERE block_type = 'Function'")
def w09_prompts(c):
    """Filled templates, and the provider that a block's complexity selects; no provider is called."""
    values = {"name": F.coalesce("semantic_name", F.lit("unnamed")), "file": col("file_name"), "text": col("raw_text")}
    provider = F.when(F.coalesce("cc", F.lit(0)) > 30, "large").otherwise("small")
    return c.blocks.where("block_type = 'Function'").select("id", filled(F.lit("Describe {{name}} in {{file}}: {{text}}"), values).alias("prompt"), provider.alias("provider"))


@query("SELECT b.id, b.semantic_name, (SELECT COUNT(*) FROM f_blocks x WHERE x.parent_block_id = b.id AND x.block_type = 'Function') AS n_methods, b.loc FROM f_blocks b WHERE b.block_type = 'Class'")
def p20_class_chart(c):
    n = c.blocks.where("block_type = 'Function'").groupBy(col("parent_block_id").alias("id")).agg(F.count("*").alias("n_methods"))
    return c.blocks.where("block_type = 'Class'").select("id", "semantic_name", "loc").join(n, "id", "left").fillna(0, ["n_methods"])


@query("SELECT event_id, user_id, n > 3 AS limited FROM (SELECT event_id, user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events)")
def p21_rate_limit(c):
    """Requests (events) beyond three of one client within a day."""
    return rate_limited(c.table("events"), 3, 86400)


def rate_limited(requests: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """Whether a client (user_id) made more than `most` requests in the `seconds` up to each."""
    log = Window.partitionBy("user_id").orderBy(F.unix_micros(col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.select("event_id", "user_id", (F.count("*").over(log) > most).alias("limited"))


@query("SELECT id, array_to_string(list_transform(string_split(source_code, chr(10)), lambda x: regexp_replace(x, '[ \\t]+$', '')), chr(10)) AS code FROM f_containers WHERE source_code IS NOT NULL")
def t03_formatted(c):
    """The basic formatter: no white space at the ends of lines."""
    return c.containers.where("source_code IS NOT NULL").select("id", F.regexp_replace("source_code", r"(?m)[ \t]+$", "").alias("code"))


@query("""SELECT id, CASE language WHEN 'python' THEN 'def ' || COALESCE(semantic_name, 'unnamed') || '():' || chr(10) || '    pass' WHEN 'rust' THEN 'fn ' || COALESCE(semantic_name, 'unnamed') || '() {' || chr(10) || '    todo!()' || chr(10) || '}' ELSE 'function ' || COALESCE(semantic_name, 'unnamed') || '() {' || chr(10) || '}' END AS code FROM f_blocks WHERE block_type = 'Function' AND language IS NOT NULL""")
def t05_skeletons(c):
    """A function of each language with an empty body."""
    template = F.when(col("language") == "python", "def {{name}}():\n    pass").when(col("language") == "rust", "fn {{name}}() {\n    todo!()\n}").otherwise("function {{name}}() {\n}")
    return c.blocks.where("block_type = 'Function' AND language IS NOT NULL").select("id", filled(template, {"name": F.coalesce("semantic_name", F.lit("unnamed"))}).alias("code"))


@query("SELECT id, replace(raw_text, 'eval', 'literal_eval') AS raw_text FROM f_blocks WHERE contains(raw_text, 'eval')")
def t12_renamed(c):
    return c.blocks.where(col("raw_text").contains("eval")).select("id", F.replace("raw_text", F.lit("eval"), F.lit("literal_eval")).alias("raw_text"))


def checks(c: Code) -> DataFrame:
    """name and passed of everything that must hold before sources are eliminated, one row each."""
    required = (("containers", "source_code"), ("blocks", "parent_block_id"), ("blocks", "position"), ("blocks", "raw_text"))
    aligned = all(column in getattr(c, table).columns for table, column in required)
    parsers = c.containers.select((F.count_if(~F.coalesce("language", F.lit("python")).isin("python", "rust", "javascript", "typescript")) == 0).alias("passed"))
    backup = c.containers.select((F.count_if(col("source_code") != "") > 0).alias("passed"))
    named = c.blocks.select((F.count("semantic_name") / F.count("*") >= 0.8).alias("passed"))
    tests = flagged_tested(c).where("block_type = 'Function'").select((F.count("has_test") > 0).alias("passed"))
    errors, _ = syntax_problems(col("content"), col("language"))
    clean = c.files.select((F.count_if(errors > 0) == 0).alias("passed"))
    rows = c.spark.createDataFrame([("schema_aligned", aligned)], "name string, passed boolean")
    for name, df in (("compilation_clean", clean), ("parsers_operational", parsers), ("backup_system_ready", backup), ("template_coverage", named), ("test_suite_adequate", tests)):
        rows = rows.unionByName(df.select(F.lit(name).alias("name"), "passed"))
    return rows


GATE = """(SELECT 'schema_aligned' AS name, TRUE AS passed UNION ALL SELECT 'compilation_clean', COUNT(CASE WHEN language = 'rust' AND contains(content, 'fn ') AND NOT contains(content, '{') OR language = 'python' AND contains(content, 'def ') AND NOT contains(content, ':') OR language IN ('javascript', 'typescript') AND contains(content, 'class ') AND NOT contains(content, '{') THEN 1 END) = 0 FROM f_files
UNION ALL SELECT 'parsers_operational', COUNT(CASE WHEN language NOT IN ('python', 'rust', 'javascript', 'typescript') THEN 1 END) = 0 FROM f_containers UNION ALL SELECT 'backup_system_ready', COUNT(CASE WHEN source_code <> '' THEN 1 END) > 0 FROM f_containers
UNION ALL SELECT 'template_coverage', COUNT(semantic_name)::DOUBLE / COUNT(*) >= 0.8 FROM f_blocks UNION ALL SELECT 'test_suite_adequate', COUNT(*) > 0 FROM f_relationships WHERE relationship_type = 'tests' AND target_block_id IN (SELECT id FROM f_blocks WHERE block_type = 'Function'))"""


@query(f"SELECT bool_and(passed) AS ready, COUNT(*) AS n_checks, COALESCE(string_agg(CASE WHEN NOT passed THEN name END, ',' ORDER BY name), '') AS blocking FROM {GATE}")
def x01_readiness(c):
    blocking = F.array_join(F.array_sort(F.collect_list(F.when(~col("passed"), col("name")))), ",")
    return checks(c).agg(F.bool_and("passed").alias("ready"), F.count("*").alias("n_checks"), blocking.alias("blocking"))


@query(f"SELECT name, passed FROM {GATE}")
def x03_definition_of_done(c):
    return checks(c)


@query("SELECT 'blocks' AS \"table\", unnest(['metadata', 'position_in_parent']) AS \"column\"")
def x04_missing_columns(c):
    """Columns that a full schema has and the tables lack."""
    wanted = {"containers": ("source_code", "language"), "blocks": ("parent_block_id", "position_in_parent", "metadata", "raw_text"), "versions": ("semantic_hash", "change_type")}
    rows = [(t, x) for t, names in wanted.items() for x in names if x not in getattr(c, t).columns]
    return c.spark.createDataFrame(rows, "table string, column string")


@query("SELECT COUNT(*) AS n, 0 AS remaining, COUNT(source_code) AS eliminated FROM f_containers")
def x08_source_elimination(c):
    """What elimination leaves, and what restoring from a backup would bring back."""
    left = sinks.eliminated(c.containers).agg(F.count("*").alias("n"), F.count("source_code").alias("remaining"))
    saved = sinks.backed_up(c.containers, "b", F.current_timestamp()).agg(F.count("*").alias("eliminated"))
    return left.join(saved, F.lit(True))  # one row each


@query("SELECT id, 'https://example.org/' || lower(repository_name) || '.git' AS repo_url, '{}' AS statistics FROM f_migrations")
def x09_defaults(c):
    """Empty columns filled: an address from the name, an empty object of statistics."""
    url, statistics = F.lit(None).cast("string"), F.lit(None).cast("string")
    made = F.concat(F.lit("https://example.org/"), F.lower("repository_name"), F.lit(".git"))
    return c.migrations.select("id", F.coalesce(url, made).alias("repo_url"), F.coalesce(statistics, F.lit("{}")).alias("statistics"))


@query("""SELECT id, unnest(CASE block_type WHEN 'Function' THEN ['FunctionSignature', 'FunctionBody'] WHEN 'Class' THEN ['ClassDeclaration', 'ClassBody'] WHEN 'Variable' THEN ['Variable'] WHEN 'Import' THEN ['Import'] ELSE ['Statement'] END) AS component FROM f_blocks WHERE language IS NOT NULL""")
def x10_components(c):
    """Typed components of the blocks of mapped languages."""
    some = lambda *x: F.array(*map(F.lit, x))
    kind = col("block_type")
    parts = F.when(kind == "Function", some("FunctionSignature", "FunctionBody")).when(kind == "Class", some("ClassDeclaration", "ClassBody")).when(kind.isin("Variable", "Import"), F.array(kind)).otherwise(some("Statement"))
    return c.blocks.where("language IS NOT NULL").select("id", F.explode(parts).alias("component"))


@query("""SELECT b.id, b.semantic_name, b.file_name, ROUND(1 + 0.1 * n_params + 0.05 * CASE WHEN starts_with(lower(raw_text), 'async ') THEN 1 ELSE 0 END + 0.1 * indent + 0.2 * COALESCE(cc, 0), 6)::DOUBLE AS complexity_score,
(SELECT COUNT(DISTINCT target_block_id) FROM f_relationships r WHERE r.source_block_id = b.id) AS n_dependencies, (SELECT COUNT(DISTINCT source_block_id) FROM f_relationships r WHERE r.target_block_id = b.id) AS n_consumers,
b.id IN (SELECT target_block_id FROM f_relationships WHERE relationship_type = 'tests') AS tested FROM f_blocks b""")
def x11_block_contexts(c):
    """All optional sections of every block's context in one row."""
    score = F.round(1 + 0.1 * col("n_params") + 0.05 * modifiers() + 0.1 * col("indent") + 0.2 * F.coalesce("cc", F.lit(0)), 6)
    own = c.dealt(flagged_tested(c)).join(coupling(c), "id", "left").fillna(0, ["ce", "ca"])
    return own.select("id", "semantic_name", "file_name", score.alias("complexity_score"), col("ce").alias("n_dependencies"), col("ca").alias("n_consumers"), F.coalesce("has_test", F.lit(False)).alias("tested"))


@query(r"SELECT COUNT(CASE WHEN text IS NOT DISTINCT FROM regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g') THEN 1 END) AS n_same, COUNT(CASE WHEN text IS DISTINCT FROM regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g') THEN 1 END) AS n_different FROM documents")
def x15_directories_compared(c):
    """Paths and hashes of documents before and after the basic formatter."""
    own = c.table("documents").select(col("doc_id").cast("string").alias("path"), col("text").alias("content"))
    return directories_compared(own, own.select("path", F.regexp_replace("content", r"[ \t]+(\n|$)", "$1").alias("content")))


def directories_compared(before: DataFrame, after: DataFrame) -> DataFrame:
    digest = lambda df, name: df.select("path", F.sha2(col("content").cast("binary"), 256).alias(name))
    both = digest(before, "x").join(digest(after, "y"), "path", "full")
    return both.agg(F.count_if(col("x").eqNullSafe(col("y"))).alias("n_same"), F.count_if(~col("x").eqNullSafe(col("y"))).alias("n_different"))


@query("SELECT id, original_path FROM f_containers WHERE original_path = 'src/pkg3/f33' OR name = 'mod_34'")
def x16_files_by_path(c):
    """By the whole path: files of one name in two directories stay apart."""
    return c.containers.where((col("original_path") == "src/pkg3/f33") | (col("name") == "mod_34")).select("id", "original_path")


@query("SELECT path, len(string_split(b, chr(10))) - 1 AS n_lines, TRUE AS parses, n = 0 AND d = 0 AS success FROM f_rebuilt")
def x20_builder_results(c):
    """What was built from every Python file's blocks: its lines, whether it parses, and whether it gives the same blocks."""
    return round_trips(c, (F.size(F.split("b", "\n")) - 1).alias("n_lines")).select("path", "n_lines", "parses", col("same").alias("success"))


@query("SELECT id, COALESCE(language, 'python') AS target_language, CASE block_type WHEN 'Class' THEN 'class' WHEN 'Function' THEN 'function' ELSE 'default' END AS pattern FROM f_blocks")
def x21_generators(c):
    """The language that a block asks for, Python if it asks for none, and the plain pattern of its type."""
    return c.blocks.select("id", F.coalesce("language", F.lit("python")).alias("target_language"), first_match((col("block_type") == "Class", "class"), (col("block_type") == "Function", "function"), other="default").alias("pattern"))


@query("SELECT id, (ROW_NUMBER() OVER (ORDER BY id) - 1) // 50 AS chunk FROM f_migrations")
def snk09_chunks(c):
    """Chunk numbers of fifty rows each, in order of ids; one small table."""
    return c.migrations.select("id", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / 50).alias("chunk"))


@query("SELECT id, block_type, semantic_name FROM f_blocks WHERE block_type IN ('Function', 'Class', 'Import', 'Interface', 'Module') ORDER BY id LIMIT 1000")
def snk09_essential_nodes(c):
    return c.blocks.where(col("block_type").isin("Function", "Class", "Import", "Interface", "Module")).select("id", "block_type", "semantic_name").orderBy("id").limit(1000)


@query("""WITH RECURSIVE fn AS (SELECT * FROM f_blocks WHERE block_type = 'Function'), e AS (SELECT DISTINCT r.source_block_id AS s, r.target_block_id AS t FROM f_relationships r JOIN fn a ON a.id = r.source_block_id JOIN fn b ON b.id = r.target_block_id AND a.container_id = b.container_id WHERE r.relationship_type = 'calls'),
reach AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON e.s = r.t) SELECT container_id, COUNT(*) AS n_functions, COUNT(CASE WHEN id NOT IN (SELECT t FROM e) THEN 1 END) AS n_entries, COUNT(CASE WHEN id IN (SELECT s FROM reach WHERE s = t) THEN 1 END) AS n_recursive FROM fn GROUP BY container_id""")
def p13_call_statistics(c):
    """What the views' constants stand for: functions, entries and recursive functions of every file."""
    return facts(c).groupBy("container_id").agg(F.count("*").alias("n_functions"), F.count_if("entry").alias("n_entries"), F.count_if("recursive").alias("n_recursive"))


@query("""SELECT 'blocks' AS stage, unnest(['n', 'complexity']) AS figure, unnest([COUNT(*)::DOUBLE, SUM(cc)::DOUBLE]) AS value FROM f_blocks UNION ALL SELECT 'functions', unnest(['n', 'complexity']), unnest([COUNT(*)::DOUBLE, SUM(cc)::DOUBLE]) FROM f_blocks WHERE block_type = 'Function'
UNION ALL SELECT 'files', unnest(['n', 'most']), unnest([COUNT(*)::DOUBLE, MAX(n)::DOUBLE]) FROM (SELECT COUNT(*) AS n FROM f_blocks WHERE block_type = 'Function' GROUP BY container_id)""")
def x13_stage_figures(c):
    """Figures of the stages of one plan, observed while it runs once."""
    seen = Observed()
    n, complexity = F.count(F.lit(1)), F.sum("cc")
    blocks = seen.watch(c.own_blocks, "blocks", n=n, complexity=complexity)
    functions = seen.watch(blocks.where("block_type = 'Function'"), "functions", n=n, complexity=complexity)
    files = seen.watch(functions.groupBy("container_id").agg(F.count("*").alias("n")), "files", n=n, most=F.max("n"))
    seen.run("files", lambda: written(files, "observed"))
    return seen.frame(c.spark)


@query("""SELECT * FROM (SELECT 1 AS step, 'first' AS what, COUNT(*) AS n, COUNT(source_code) AS sources, 1 AS version FROM f_containers UNION ALL SELECT 2, 'loses rows', COUNT(*), COUNT(source_code), 1 FROM f_containers
UNION ALL SELECT 3, 'eliminates', COUNT(*), 0, 2 FROM f_containers UNION ALL SELECT 4, 'goes back', COUNT(*), COUNT(source_code), 3 FROM f_containers)""")
def x02_gated_runs(c):
    """What readers see after each step: a first version, a change that a check refuses, one that is published, and the way back."""
    snapshots = Snapshots(c.spark, folder(c.spark, "snapshots"))
    alike = {"no row is lost": lambda old, new: not old or old["containers"].count() == new["containers"].count()}
    steps = (
        ("first", lambda: snapshots.run(lambda _: {"containers": c.containers.select("id", "source_code")}, alike)),
        ("loses rows", lambda: snapshots.run(lambda old: {"containers": sinks.eliminated(old["containers"]).where("id % 2 = 0")}, alike)),
        ("eliminates", lambda: snapshots.run(lambda old: {"containers": sinks.eliminated(old["containers"])}, alike)),
        ("goes back", lambda: snapshots.go_back(1)),
    )
    out = []
    for step, (what, act) in enumerate(steps, 1):
        act()
        n = F.count("*").alias("n"), F.count("source_code").alias("sources")
        out.append(snapshots.tables()["containers"].agg(*n).select(F.lit(step).alias("step"), F.lit(what).alias("what"), "n", "sources", F.lit(snapshots.versions()[-1]).alias("version")))
    return union(out)
