"""Extraction from source texts, intents of users, generation of texts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import brace_source, expressions, python_source, source_text
from codequarry.operators.scores import QUALITY, counted, rated, round_trips, words
from codequarry.operators.screens import first_match
from codequarry.plans.registry import query
from codequarry.sources.code import Code

col = F.col


def sources(c: Code, *languages: str) -> DataFrame:
    """path and content of the files in some languages."""
    return c.files.where(col("language").isin(*languages)).select("path", "content")


def nodes(c: Code, *languages: str) -> DataFrame:
    """Syntax nodes of the files in some languages with braces, all if none is given."""
    return brace_source.nodes(c.files.where(col("language").isin(*languages)) if languages else c.files)


PY = "p AS (SELECT path, n, d FROM f_files WHERE language = 'python'), member AS (SELECT *, unnest(range(n)) AS i FROM p), branch AS (SELECT *, unnest(range(d)) AS j FROM p)"


@query("SELECT id, CASE WHEN source_code IS NULL THEN NULL ELSE language END AS parser, language IN ('python', 'javascript', 'typescript', 'rust') AS supported FROM f_containers WHERE language IS NOT NULL")
def ext01_parsers(c):
    return c.containers.where("language IS NOT NULL").select("id", F.when(col("source_code").isNotNull(), col("language")).alias("parser"), col("language").isin("python", "javascript", "typescript", "rust").alias("supported"))


@query(f"""WITH {PY}, b AS (SELECT path, 0 AS position, NULL AS parent, 'Import' AS block_type, 'os' AS name, '[]' AS parameters, 1 AS start_line, 1 AS end_line FROM p
UNION ALL SELECT path, 1, NULL, 'Class', 'C' || path, '[]', 2, 3 + 4 * n FROM p UNION ALL SELECT path, 2 + i, 1, 'Function', 'm', '["self", "a"]', 3 + 4 * i, 6 + 4 * i FROM member
UNION ALL SELECT path, n + 2, NULL, 'Function', 'g', '["x"]', 4 + 4 * n, 5 + 4 * n + d FROM p UNION ALL SELECT path, n + 3, NULL, 'Class', 'D', '[]', 6 + 4 * n + d, 10 + 4 * n + d FROM p
UNION ALL SELECT path, n + 4, n + 3, 'Function', 'o', '["self"]', 7 + 4 * n + d, 10 + 4 * n + d FROM p UNION ALL SELECT path, n + 5, n + 4, 'Function', 'p', '["q"]', 8 + 4 * n + d, 9 + 4 * n + d FROM p) SELECT * FROM b""")
def ext05_python_blocks(c):
    return python_source.blocks(sources(c, "python")).select("path", "position", "parent", "block_type", "name", "parameters", "start_line", "end_line")


@query(f"WITH {PY} SELECT path, 2 + i AS source, n + 2 AS target, 'calls' AS kind FROM member UNION ALL SELECT path, n + 4, n + 5, 'calls' FROM p UNION ALL SELECT path, n + 3, 1, 'inherits' FROM p")
def ext04_python_relations(c):
    """The first class's base is not defined in the file, so that its relation is dropped."""
    return python_source.relations(sources(c, "python"))


@query(f"""WITH {PY} SELECT path, 'm' AS name, 'if' AS control_flow, 'g(a),os.path' AS returned, 'g' AS calls FROM member UNION ALL SELECT path, 'g', array_to_string(list_transform(range(d), lambda j: 'if'), ','), 'x', '' FROM p
UNION ALL SELECT path, 'o', '', 'q,p(1)', 'p' FROM p UNION ALL SELECT path, 'p', '', 'q', '' FROM p""")
def ext06_python_details(c):
    own = python_source.blocks(sources(c, "python")).where("details IS NOT NULL")
    parts = F.from_json("details", "control_flow array<string>, returns array<string>, calls array<string>")
    own = own.select("path", "name", parts.alias("d"))
    return own.select("path", "name", F.array_join("d.control_flow", ",").alias("control_flow"), F.array_join("d.returns", ",").alias("returned"), F.array_join("d.calls", ",").alias("calls"))


@query("SELECT path, position, parent, CASE slot WHEN 'import' THEN 'Import' WHEN 'type' THEN 'Class' WHEN 'member' THEN 'Method' ELSE 'Function' END AS block_type, name, CASE slot WHEN 'member' THEN 'x,y' WHEN 'function' THEN 'y' ELSE '' END AS parameters FROM f_nodes WHERE language IN ('javascript', 'typescript') AND slot <> 'branch'")
def ext07_javascript_blocks(c):
    kind = source_text.mapped(col("type"), {"import": "Import", "export": "Export", "class": "Class", "method": "Method", "function": "Function", "interface": "Interface", "type": "TypeDef"})
    own = nodes(c, "javascript", "typescript").withColumn("block_type", kind).where("block_type IS NOT NULL")
    return own.select("path", "position", "parent", "block_type", "name", F.array_join("parameters.name", ",").alias("parameters"))


@query("SELECT path, position, parent, CASE slot WHEN 'import' THEN 'Import' WHEN 'type' THEN 'Impl' ELSE 'Function' END AS block_type, name FROM f_nodes WHERE language = 'rust' AND slot <> 'branch'")
def ext08_rust_blocks(c):
    kind = source_text.mapped(col("kind"), {"use_declaration": "Import", "impl_item": "Impl", "struct_item": "Class", "enum_item": "Class", "trait_item": "Interface", "mod_item": "Module", "function_item": "Function", "macro_definition": "Macro"})
    own = nodes(c, "rust").withColumn("block_type", kind).where("block_type IS NOT NULL")
    return own.select("path", "position", "parent", "block_type", "name")


@query("""SELECT path, kind, name, CASE slot WHEN 'member' THEN 'pub' ELSE '' END AS modifiers, CASE slot WHEN 'function' THEN 'T : Clone' ELSE '' END AS generics, CASE slot WHEN 'member' THEN '&mut self,x:Vec<u8>' WHEN 'function' THEN 'y:T' ELSE '' END AS parameters,
CASE slot WHEN 'member' THEN 'u8' WHEN 'function' THEN 'i32' END AS returns FROM f_nodes WHERE language = 'rust' AND slot IN ('type', 'member', 'function')""")
def ext09_rust_signatures(c):
    """Types and functions with their modifiers, generics, parameters and what they return."""
    own = nodes(c, "rust").where(col("kind").isin("impl_item", "struct_item", "enum_item", "trait_item", "mod_item", "function_item", "macro_definition"))
    parameters = F.array_join(F.transform("parameters", lambda x: F.concat_ws(":", x["name"], x["type"])), ",")
    return own.select("path", "kind", "name", F.array_join("modifiers", " ").alias("modifiers"), F.array_join("generics", ",").alias("generics"), parameters.alias("parameters"), "returns")


@query("SELECT path, component, name, n_parameters FROM (SELECT path, CASE slot WHEN 'import' THEN 'Import' WHEN 'type' THEN 'ClassDeclaration' ELSE 'FunctionSignature' END AS component, name, CASE slot WHEN 'member' THEN 2 WHEN 'function' THEN 1 ELSE 0 END AS n_parameters FROM f_nodes WHERE language IN ('javascript', 'typescript', 'rust') AND slot <> 'branch')")
def x19_components(c):
    """Components of scripts and of Rust sources, by the same parser."""
    part = source_text.mapped(col("type"), {"import": "Import", "class": "ClassDeclaration", "implementation": "ClassDeclaration", "struct": "ClassDeclaration", "trait": "ClassDeclaration", "function": "FunctionSignature", "method": "FunctionSignature"})
    return nodes(c, "javascript", "typescript", "rust").select("path", part.alias("component"), "name", F.size("parameters").alias("n_parameters")).where("component IS NOT NULL")


@query("""SELECT path, position, parent, level, COALESCE(t.type, f.kind) AS type, f.kind, name, line, end_line FROM f_nodes f LEFT JOIN (VALUES ('import_statement', 'import'), ('use_declaration', 'import'), ('import_declaration', 'import'), ('preproc_include', 'include'), ('package_clause', 'package'), ('class_declaration', 'class'),
('impl_item', 'implementation'), ('type_declaration', 'type'), ('struct_specifier', 'struct'), ('method_definition', 'method'), ('method_declaration', 'method'), ('function_declaration', 'function'), ('function_item', 'function'), ('function_definition', 'function')) t(kind, type) ON t.kind = f.kind""")
def ext20_nodes(c):
    return nodes(c).select("path", "position", "parent", "level", "type", "kind", "name", "line", "end_line")


@query("""SELECT path, 1.0::DOUBLE + d AS complexity, g + 2 + m + w + 1 + d AS n_nodes, GREATEST(w + d, CASE WHEN m > 0 THEN 1 ELSE 0 END) AS deepest, CASE language WHEN 'javascript' THEN 'K' || path WHEN 'typescript' THEN 'K' || path WHEN 'c' THEN 'K' || path WHEN 'java' THEN 'K' || path || ',F' || path ELSE '' END AS classes, repeat('m,', m) || 'f' || path AS functions, 1 AS n_imports FROM f_layout""")
def ext20_figures(c):
    return brace_source.figures(nodes(c)).withColumns({k: F.array_join(k, ",") for k in ("classes", "functions")})


@query("""SELECT path, array_to_string(list_filter([CASE WHEN n > 0 THEN 'ConsoleIO' END, CASE WHEN d = 1 THEN 'FileIO' END, CASE WHEN d = 2 THEN 'ExceptionThrowing' END], lambda x: x IS NOT NULL), ',') AS effects, CASE WHEN d = 1 THEN 'Impure' WHEN n > 0 OR d = 2 THEN 'MostlyPure' ELSE 'Pure' END AS purity, 'std::fs' AS uses, n > 0 OR d = 2 AS is_mutable FROM f_files WHERE language = 'rust'""")
def ext10_rust_effects(c):
    own = sources(c, "rust").withColumn("e", source_text.side_effects(col("content")))
    return own.select("path", F.array_join("e.effect", ",").alias("effects"), source_text.purity(col("e")).alias("purity"), F.array_join(source_text.uses(col("content")), ",").alias("uses"), source_text.mutability(col("content"))["is_mutable"].alias("is_mutable"))


@query("SELECT id, ROUND(CASE WHEN LEAST(cc, cognitive, loc) <= 0 THEN 100 ELSE LEAST(100, GREATEST(0, 171 - 5.2 * ln(cc) - 0.23 * ln(cognitive) - 16.2 * ln(loc))) END, 6)::DOUBLE AS maintainability_index FROM f_blocks WHERE cc IS NOT NULL")
def ext13_maintainability(c):
    return c.blocks.where("cc IS NOT NULL").select("id", F.round(source_text.maintainability(col("cc"), col("cognitive"), col("loc")), 6).alias("maintainability_index"))


@query(f"""WITH {PY} SELECT path, 'import' AS type, 1 AS line, 1 AS complexity FROM p UNION ALL SELECT path, 'class', 2, 1 + n FROM p UNION ALL SELECT path, unnest(['function', 'if', 'return', 'return', 'call']), 3 + 4 * i + unnest([0, 1, 2, 3, 2]), unnest([2, 1, 1, 1, 1]) FROM member
UNION ALL SELECT path, unnest(['assignment', 'function', 'return']), 3 + 4 * n + unnest([0, 1, 2 + d]), unnest([1, 1 + d, 1]) FROM p UNION ALL SELECT path, 'if', 5 + 4 * n + j, 1 FROM branch
UNION ALL SELECT path, unnest(['class', 'function', 'function', 'return', 'return', 'call']), 6 + 4 * n + d + unnest([0, 1, 2, 3, 4, 4]), 1 FROM p""")
def ext14_python_nodes(c):
    return python_source.nodes(sources(c, "python")).select("path", "type", "line", "complexity")


@query(f"""WITH {PY} SELECT path, 'os' AS imports, '' AS exports, 'C' || path || ',D' AS classes, repeat('m,', n) || 'g,o' AS functions, 'k' AS variables, 1.0::DOUBLE + n + d AS complexity, 1.0::DOUBLE AS simple_complexity, 11 + 4 * n + d AS lines FROM p""")
def ext15_python_figures(c):
    listed = [F.array_join(k, ",").alias(k) for k in ("imports", "exports", "classes", "functions", "variables")]
    return python_source.figures(sources(c, "python")).select("path", *listed, "complexity", "simple_complexity", "lines")


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS file, CASE WHEN ends_with(url, '.py') THEN 'python' WHEN ends_with(url, '.js') THEN 'javascript' END AS language FROM pages")
def ext21_languages(c):
    return c.table("pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("file"), source_text.language_of(col("url")).alias("language"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: list_position(w, x))), lambda i: w[i]), ' ') AS distinct_words FROM (SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)")
def ext22_distinct_in_order(c):
    """Repeated words go, the first ones stay in their order."""
    return c.table("documents").select("doc_id", F.array_join(F.array_distinct(words(F.coalesce("text", F.lit("")))), " ").alias("distinct_words"))


@query("SELECT id, CASE WHEN contains(lower(name), 'test') THEN 'test' ELSE 'code' END AS container_type FROM f_containers")
def ext23_container_types(c):
    return c.containers.select("id", source_text.container_type(col("name")).alias("container_type"))


@query("""SELECT id, CASE WHEN semantic_name IS NULL THEN 'unknown' WHEN language = 'python' THEN CASE WHEN starts_with(semantic_name, 'std') OR contains(semantic_name, 'os') OR contains(semantic_name, 'sys') OR contains(semantic_name, 'json') OR contains(semantic_name, 're') OR contains(semantic_name, 'datetime') THEN 'stdlib' WHEN starts_with(semantic_name, '.') THEN 'local' ELSE 'third_party' END
WHEN language = 'rust' THEN CASE WHEN starts_with(semantic_name, 'std::') THEN 'stdlib' WHEN starts_with(semantic_name, 'crate::') OR starts_with(semantic_name, 'super::') THEN 'local' ELSE 'third_party' END
WHEN language IN ('javascript', 'typescript') THEN CASE WHEN starts_with(semantic_name, '.') THEN 'local' WHEN starts_with(semantic_name, '@') OR NOT contains(semantic_name, '/') THEN 'third_party' ELSE 'stdlib' END ELSE 'unknown' END AS category FROM f_blocks WHERE block_type = 'Import'""")
def t06_import_categories(c):
    name, language = col("semantic_name"), col("language")
    python = first_match((name.startswith("std") | source_text.any_of(name, ("os", "sys", "json", "re", "datetime")), "stdlib"), (name.startswith("."), "local"), other="third_party")
    rust = first_match((name.startswith("std::"), "stdlib"), (name.startswith("crate::") | name.startswith("super::"), "local"), other="third_party")
    js = first_match((name.startswith("."), "local"), (name.startswith("@") | ~name.contains("/"), "third_party"), other="stdlib")
    kind = F.when(name.isNull(), "unknown").when(language == "python", python).when(language == "rust", rust).when(language.isin("javascript", "typescript"), js).otherwise("unknown")
    return c.blocks.where("block_type = 'Import'").select("id", kind.alias("category"))


#: Words of intents, by pattern.
INTENTS = {
    "error_handling": ("error", "exception", "handle", "graceful", "retry", "fallback"),
    "performance": ("optimize", "performance", "faster", "cache", "speed", "efficient"),
    "security": ("secure", "validate", "sanitize", "authenticate", "authorize", "encrypt"),
    "testing": ("test", "coverage", "unit", "integration", "verify"),
}
ACTIONS = ("create", "add", "remove", "update", "modify", "optimize", "fix", "implement")
GOOD, BAD = ("good", "great", "excellent", "improve", "optimize", "better"), ("bad", "broken", "fix", "error", "problem", "issue")


def intent(text: Column) -> list[Column]:
    """Confidence of every pattern, the first action word and the sentiment of a text."""
    own = words(F.lower(text))
    seen = lambda k: F.exists(own, lambda w: w.contains(k)).cast("int")
    share = lambda keys: F.round(reduce(add, map(seen, keys)) / len(keys), 6)
    n = lambda of: F.size(F.filter(own, lambda w: w.isin(*of)))
    mood = F.when(n(GOOD) + n(BAD) == 0, 0.0).otherwise((n(GOOD) - n(BAD)) / (n(GOOD) + n(BAD)))
    return [*(share(keys).alias(k) for k, keys in INTENTS.items()), F.get(F.filter(own, lambda w: w.isin(*ACTIONS)), F.lit(0)).alias("primary_action"), F.round(mood, 6).alias("sentiment")]


def _listed(of) -> str:
    return ", ".join(f"'{x}'" for x in of)


def _share(keys) -> str:
    return "ROUND((" + " + ".join(f"CASE WHEN len(list_filter(w, lambda x: contains(x, '{k}'))) > 0 THEN 1 ELSE 0 END" for k in keys) + f")::DOUBLE / {len(keys)}, 6)"


TURNS = r"(SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'user')"
MOOD = f"len(list_filter(w, lambda x: x IN ({_listed(GOOD)}))) AS g, len(list_filter(w, lambda x: x IN ({_listed(BAD)}))) AS b"
SHARES = ", ".join(f"{_share(keys)} AS {k}" for k, keys in INTENTS.items())


@query(f"SELECT conv_id, turn, {SHARES}, list_filter(w, lambda x: x IN ({_listed(ACTIONS)}))[1] AS primary_action, ROUND(CASE WHEN g + b = 0 THEN 0 ELSE (g - b)::DOUBLE / (g + b) END, 6) AS sentiment FROM (SELECT *, {MOOD} FROM {TURNS})")
def t07_intents(c):
    return c.table("conversations").where("role = 'user'").select("conv_id", "turn", *intent(F.coalesce("text", F.lit(""))))


@query(f"SELECT conv_id, turn, n AS operations, 2.0::DOUBLE * n AS hours, CASE WHEN n > 5 THEN 'Complex' WHEN n > 2 THEN 'Moderate' ELSE 'Simple' END AS difficulty, n > 3 AS at_risk FROM (SELECT conv_id, turn, " + " + ".join(f"CASE WHEN {k} > 0 THEN 1 ELSE 0 END" for k in INTENTS) + f" AS n FROM (SELECT conv_id, turn, {SHARES} FROM {TURNS}))")
def t08_effort(c):
    """An operation for each pattern that a text matches."""
    n = reduce(add, ((col(k) > 0).cast("int") for k in INTENTS))
    own = t07_intents(c).select("conv_id", "turn", n.alias("operations"))
    return own.withColumns({"hours": 2.0 * col("operations"), "difficulty": first_match((col("operations") > 5, "Complex"), (col("operations") > 2, "Moderate"), other="Simple"), "at_risk": col("operations") > 3})


@query("""SELECT id, CASE WHEN block_type = 'Class' THEN CASE WHEN contains(n, 'getInstance') OR contains(d, 'single instance') THEN 'singleton' WHEN contains(n, 'create') OR contains(n, 'make') OR contains(d, 'factory') OR contains(d, 'create object') THEN 'factory' WHEN contains(n, 'build') OR contains(n, 'with') OR contains(d, 'builder') OR contains(d, 'step by step') THEN 'builder'
WHEN contains(n, 'notify') OR contains(n, 'subscribe') OR contains(n, 'observe') OR contains(n, 'listen') OR contains(d, 'observer') OR contains(d, 'event') THEN 'observer' WHEN contains(n, 'execute') OR contains(n, 'algorithm') OR contains(d, 'strategy') OR contains(d, 'algorithm') THEN 'strategy' WHEN contains(d, 'facade') OR contains(d, 'simplified interface') OR contains(d, 'unified interface') THEN 'facade' ELSE 'class' END
WHEN block_type = 'Function' THEN CASE WHEN starts_with(lower(raw_text), 'async ') THEN 'async_function' ELSE 'function' END ELSE 'default' END AS pattern FROM (SELECT *, COALESCE(semantic_name, '') AS n, lower(COALESCE(semantic_name, '') || ' ' || raw_text) AS d FROM f_blocks)""")
def t09_pattern_selection(c):
    """A block's name is its behaviour's, its name and text the description."""
    name = F.coalesce("semantic_name", F.lit(""))
    said = F.lower(F.concat_ws(" ", name, "raw_text"))
    hit = lambda names, parts: source_text.any_of(said, parts) | source_text.any_of(name, names) if names else source_text.any_of(said, parts)
    kinds = (
        ("singleton", ("getInstance",), ("single instance",)), ("factory", ("create", "make"), ("factory", "create object")), ("builder", ("build", "with"), ("builder", "step by step")), ("observer", ("notify", "subscribe", "observe", "listen"), ("observer", "event")),
        ("strategy", ("execute", "algorithm"), ("strategy", "algorithm")), ("facade", (), ("facade", "simplified interface", "unified interface")),
    )
    of_class = first_match(*((hit(names, parts), kind) for kind, names, parts in kinds), other="class")
    of_function = F.when(col("raw_text").ilike("async %"), "async_function").otherwise("function")
    return c.blocks.select("id", F.when(col("block_type") == "Class", of_class).when(col("block_type") == "Function", of_function).otherwise("default").alias("pattern"))


@query("""SELECT conv_id, 1 + COUNT(*) AS complexity_score, CASE WHEN bool_or(contains(t, 'validate') OR contains(t, 'check')) THEN 1 ELSE 0 END + CASE WHEN bool_or(contains(t, 'async') OR contains(t, 'await')) THEN 1 ELSE 0 END + CASE WHEN bool_or(contains(t, 'error') OR contains(t, 'exception')) THEN 1 ELSE 0 END + CASE WHEN bool_or(contains(t, 'concurrent')) THEN 1 ELSE 0 END AS n_patterns
FROM (SELECT conv_id, COALESCE(text, '') AS t FROM conversations) GROUP BY conv_id""")
def t10_specifications(c):
    """A conversation is a specification, its turns the examples."""
    said = lambda *parts: F.bool_or(source_text.any_of(F.coalesce("text", F.lit("")), parts)).cast("int")
    n = said("validate", "check") + said("async", "await") + said("error", "exception") + said("concurrent")
    return c.table("conversations").groupBy("conv_id").agg((1 + F.count("*")).alias("complexity_score"), n.alias("n_patterns"))


SQL_GENERATED = """WITH RECURSIVE tree AS (SELECT id, container_id, block_type, semantic_name, raw_text, lpad(CAST(position AS VARCHAR), 6, '0') AS key, 0 AS level FROM f_blocks WHERE parent_block_id IS NULL
UNION ALL SELECT b.id, b.container_id, b.block_type, b.semantic_name, b.raw_text, t.key || '/' || lpad(CAST(b.position AS VARCHAR), 6, '0'), t.level + 1 FROM f_blocks b JOIN tree t ON b.parent_block_id = t.id)
SELECT container_id, string_agg(repeat('  ', level) || raw_text, chr(10) ORDER BY block_type <> 'Import', CASE WHEN block_type = 'Import' THEN COALESCE(semantic_name, '') ELSE '' END, key) AS code FROM tree GROUP BY container_id"""
SQL_FILES = SQL_GENERATED.replace("SELECT container_id, string_agg", "SELECT (SELECT original_path || CASE language WHEN 'python' THEN '.py' WHEN 'rust' THEN '.rs' WHEN 'javascript' THEN '.js' WHEN 'typescript' THEN '.ts' ELSE '.txt' END FROM f_containers c WHERE c.id = container_id) AS path, string_agg")


@query(SQL_GENERATED)
def t01_generated_files(c):
    """A file's imports first, by name, then its blocks in pre-order, indented by level."""
    from codequarry.operators.screens import v26_block_hierarchy

    own = v26_block_hierarchy(c).select("id", "path", "level").join(c.blocks.select("id", "container_id", "block_type", "semantic_name", "raw_text"), "id")
    late = col("block_type") != "Import"
    # positions are the last two digits of ids, so that paths of ids of one file sort as those of positions
    place = F.transform(F.split("path", "/"), lambda x: F.lpad(x, 20, "0"))
    row = F.struct(late.alias("late"), F.when(late, "").otherwise(F.coalesce("semantic_name", F.lit(""))).alias("name"), place.alias("place"), F.concat(F.repeat(F.lit("  "), col("level")), "raw_text").alias("text"))
    return own.groupBy("container_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), "\n").alias("code"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """Template with {{name}} replaced by values."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), kv[1]), values.items(), template)


#: By language and type of block: what it is written as. {{name}} and {{parameters}} (names between commas) are filled in.
TEMPLATES = {
    ("python", "Function"): "def {{name}}({{parameters}}):\n    pass\n", ("python", "Class"): "class {{name}}:\n    pass\n", ("python", "Import"): "import {{name}}\n", ("python", "Variable"): "{{name}} = None\n",
    ("javascript", "Function"): "function {{name}}({{parameters}}) {\n}\n", ("javascript", "Class"): "class {{name}} {\n}\n", ("javascript", "Import"): "import '{{name}}';\n", ("javascript", "Variable"): "let {{name}};\n", ("javascript", "Module"): "export const {{name}} = {};\n",
    ("typescript", "Function"): "function {{name}}({{parameters}}): void {\n}\n", ("typescript", "Class"): "class {{name}} {\n}\n", ("typescript", "Import"): "import '{{name}}';\n", ("typescript", "Variable"): "let {{name}}: unknown;\n", ("typescript", "Interface"): "interface {{name}} {\n}\n", ("typescript", "Module"): "namespace {{name}} {\n}\n",
    ("rust", "Function"): "fn {{name}}() {\n    todo!()\n}\n", ("rust", "Class"): "struct {{name}};\n", ("rust", "Import"): "use {{name}};\n", ("rust", "Variable"): "static {{name}}: () = ();\n", ("rust", "Interface"): "trait {{name}} {\n}\n", ("rust", "Module"): "mod {{name}} {\n}\n",
}
TEMPLATE_SQL = "CASE language || '|' || block_type " + " ".join("WHEN '{}|{}' THEN '{}'".format(*k, v.replace("'", "''")) for k, v in TEMPLATES.items()) + " END"


def template(language: Column, kind: Column) -> Column:
    """The text for a type of block in a language, null if there is none."""
    return source_text.mapped(F.concat_ws("|", language, kind), {"|".join(k): v for k, v in TEMPLATES.items()})


@query(f"SELECT id, replace(replace(x, '{{{{name}}}}', COALESCE(semantic_name, 'unnamed')), '{{{{parameters}}}}', array_to_string(list_transform(range(1, n_params + 1), lambda i: 'p' || i), ', ')) AS code FROM (SELECT *, {TEMPLATE_SQL} AS x FROM f_blocks) WHERE x IS NOT NULL")
def t02_templates(c):
    """Every block that has a template, filled with its name and as many parameters as it has."""
    parameters = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), col("n_params")), lambda i: i > 0), lambda i: F.concat(F.lit("p"), i.cast("string"))), ", ")
    own = c.blocks.withColumn("x", template(col("language"), col("block_type"))).where("x IS NOT NULL")
    return own.select("id", filled(col("x"), {"name": F.coalesce("semantic_name", F.lit("unnamed")), "parameters": parameters}).alias("code"))


@query(f"SELECT language, block_type, {TEMPLATE_SQL} IS NOT NULL AS renderable, n FROM (SELECT language, block_type, COUNT(*) AS n FROM f_blocks WHERE language IS NOT NULL GROUP BY language, block_type)")
def x05_template_coverage(c):
    """The languages and types of the blocks there are, whether a template renders them, and how many blocks that is."""
    own = c.blocks.where("language IS NOT NULL").groupBy("language", "block_type").agg(F.count("*").alias("n"))
    return own.select("language", "block_type", template(col("language"), col("block_type")).isNotNull().alias("renderable"), "n")


@query("SELECT migration_id, COUNT(*) AS n_tests, ROUND(100 * AVG(CASE WHEN n = 0 AND d = 0 THEN 1 ELSE 0 END), 6) AS accuracy FROM f_rebuilt GROUP BY migration_id")
def x06_round_trip_accuracy(c):
    """Files are parsed, written from their blocks, parsed again and compared; those pass whose blocks are the same, complexity included."""
    return round_trips(c).groupBy("migration_id").agg(F.count("*").alias("n_tests"), F.round(100 * F.avg(col("same").cast("int")), 6).alias("accuracy"))


@query(f"""WITH p AS (SELECT path AS id, a, b FROM f_rebuilt), {QUALITY} SELECT migration_id, COUNT(*) AS n, COUNT(CASE WHEN quality >= 0.7 THEN 1 END) AS successes, ROUND(AVG(CASE WHEN quality >= 0.7 THEN quality END), 5) AS mean_quality, ROUND(100.0 * COUNT(CASE WHEN quality >= 0.7 THEN 1 END) / COUNT(*), 6) AS progress
FROM f_rebuilt JOIN q ON q.id = path GROUP BY migration_id""")
def x07_elimination_run(c):
    """Of every migration: its files, those whose generated text has a quality of 0.7 or more, the mean quality of these, and their share."""
    trips = round_trips(c, *counted(), col("kept")).withColumn("quality", rated(col("kept")))
    good = col("quality") >= 0.7
    return trips.groupBy("migration_id").agg(F.count("*").alias("n"), F.count_if(good).alias("successes"), F.round(F.avg(F.when(good, col("quality"))), 5).alias("mean_quality"), F.round(100.0 * F.count_if(good) / F.count("*"), 6).alias("progress"))


@query("SELECT id, semantic_name, block_type FROM f_blocks WHERE body_ast IS NOT NULL AND semantic_name <> ''")
def x18_generation_ready(c):
    return c.blocks.where("body_ast IS NOT NULL AND semantic_name <> ''").select("id", "semantic_name", "block_type")


@query("SELECT path, 'std::fs' AS dependency FROM f_files WHERE language = 'rust'")
def ext11_uses(c):
    return sources(c, "rust").select("path", F.explode(source_text.uses(col("content"))).alias("dependency"))


@query("SELECT path, n > 0 OR d = 2 AS is_mutable, n > 0 AS mutates_self, n = 0 AND d = 2 AS mutates_parameters, d = 2 AS mutates_globals, length(content) AS estimated_bytes, 7 + 3 * n + 2 * d AS estimated_operations FROM f_files WHERE language = 'rust'")
def ext12_resources(c):
    """Flags of mutability, and the estimates of memory (bytes of text) and work (lines)."""
    own = sources(c, "rust")
    return own.select("path", F.inline(F.array(source_text.mutability(col("content")))), F.octet_length("content").alias("estimated_bytes"), (F.size(F.split("content", "\n")) - 1).alias("estimated_operations"))


@query(f"WITH {PY} SELECT path, unnest([0, 1, n + 2, n + 3, n + 4, n + 5]) AS position, unnest([0, 0, 0, 0, 1, 2]) AS depth FROM p UNION ALL SELECT path, 2 + i, 1 FROM member")
def ext03_scopes(c):
    """Pre-order positions of blocks and how many scopes hold them."""
    return python_source.blocks(sources(c, "python")).select("path", "position", "depth")


@query(f"WITH {PY} SELECT path, 1.0::DOUBLE + n + d AS complexity FROM p")
def ext16_file_complexity(c):
    return python_source.figures(sources(c, "python")).select("path", "complexity")


@query(f"WITH {PY} SELECT path, 1.0::DOUBLE AS complexity FROM p")
def ext17_simple_complexity(c):
    """Branches and definitions by all nodes are fewer than one, so that the least value holds for every file."""
    return python_source.figures(sources(c, "python")).select("path", col("simple_complexity").alias("complexity"))


@query(f"WITH {PY} SELECT path, 'm' AS name, 2 AS complexity FROM member UNION ALL SELECT path, unnest(['g', 'o', 'p']), unnest([1 + d, 1, 1]) FROM p")
def ext18_function_complexity(c):
    return python_source.blocks(sources(c, "python")).where("block_type = 'Function'").select("path", "name", "complexity")


@query(f"WITH {PY}, x AS (SELECT path, 'class' AS type, 'C' || path AS name, 2 AS line FROM p UNION ALL SELECT path, 'function', 'm', 3 + 4 * i FROM member UNION ALL SELECT path, unnest(['function', 'class', 'function', 'function']), unnest(['g', 'D', 'o', 'p']), 4 + 4 * n + unnest([0, 2 + d, 3 + d, 4 + d]) FROM p) SELECT md5(path || ':' || name || ':' || line) AS id, * FROM x")
def ext19_definitions(c):
    own = python_source.nodes(sources(c, "python")).where("type IN ('class', 'function', 'async_function')")
    return own.select(F.md5(F.concat_ws(":", "path", "name", "line").cast("binary")).alias("id"), "path", "type", "name", "line")


@query(SQL_FILES)
def t04_repository(c):
    """Every file of a repository: its path, by language, and its generated text."""
    extension = F.when(col("language") == "python", ".py").when(col("language") == "rust", ".rs").when(col("language") == "javascript", ".js").when(col("language") == "typescript", ".ts").otherwise(".txt")
    return t01_generated_files(c).join(c.containers.select(col("id").alias("container_id"), "original_path", "language"), "container_id").select(F.concat("original_path", extension).alias("path"), "code")


@query("""SELECT id, CASE s WHEN 0 THEN 'binary' WHEN 1 THEN 'binary' WHEN 2 THEN 'boolean' WHEN 3 THEN CASE WHEN k = 0 THEN 'identifier' ELSE 'binary' END WHEN 4 THEN 'conditional' ELSE 'binary' END AS kind, CASE s WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN 'or' WHEN 3 THEN CASE WHEN k > 0 THEN '+' END WHEN 5 THEN '%' END AS operator,
CASE s WHEN 0 THEN 5 WHEN 1 THEN 13 WHEN 2 THEN 10 WHEN 3 THEN 2 * k + 1 WHEN 4 THEN 16 ELSE 13 END AS n_nodes, CASE s WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN k + 1 WHEN 4 THEN 5 ELSE 5 END AS depth, CASE s WHEN 0 THEN 11 WHEN 1 THEN 29 WHEN 2 THEN 24 WHEN 3 THEN 1 + 5 * k WHEN 4 THEN 36 ELSE 24 END AS score,
CASE s WHEN 1 THEN 'f,g,h' WHEN 4 THEN 'f' WHEN 5 THEN 'run' ELSE '' END AS calls, CASE s WHEN 1 THEN 'z' WHEN 2 THEN 'e,d' WHEN 5 THEN 'run' ELSE '' END AS attributes, CASE s WHEN 0 THEN 'x,y' WHEN 1 THEN 'x,y' WHEN 2 THEN 'a,b,c' WHEN 3 THEN CASE WHEN k > 0 THEN 'x,y' ELSE 'y' END WHEN 4 THEN 'x,y,i,p,q,r,v' ELSE 'obj,rest,x,y' END AS variables
FROM (SELECT id, id % 6 AS s, id % 20 AS k FROM f_expressions)""")
def ext24_expressions(c):
    own = expressions.trees(c.expressions, "text", "id")
    return own.select("id", "kind", "operator", "n_nodes", "depth", "score", *(F.array_join(k, ",").alias(k) for k in ("calls", "attributes", "variables")))
