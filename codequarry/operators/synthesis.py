"""Specifications and what is written from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.source_text import mapped
from codequarry.operators.graph import CALLS, calls, layers
from codequarry.operators.screens import function
from codequarry.plans.registry import query

col = F.col
#: By type of specification: the element's name if it has none, and the parts that are kept.
PARTS = {
    "function": ("unnamed_function", ("parameters", "return_type", "visibility", "async", "documentation")),
    "class": ("UnnamedClass", ("inherits", "implements", "methods", "fields", "visibility")),
    "module": ("unnamed_module", ("exports", "imports", "type")),
    "interface": ("UnnamedInterface", ("methods", "extends")),
    "behavior": ("unnamed_behavior", ("preconditions", "postconditions", "invariants", "side_effects")),
}


def parsed_specification(kind: Column, content: Column) -> Column:
    """Of a specification in JSON: its name, the parts that its type keeps (names to JSON), imports and constraints. Text that is no object has none."""
    parts = F.from_json(content, "map<string,string>")
    names = F.create_map(*(x for k, (_, own) in PARTS.items() for x in (F.lit(k), F.array(*map(F.lit, own)))))[kind]
    kept = F.map_filter(parts, lambda k, _: F.array_contains(names, k))
    name = F.coalesce(parts["name"], mapped(kind, {k: own for k, (own, _) in PARTS.items()}))
    constraints = F.transform(F.map_entries(F.from_json(parts["constraints"], "map<string,string>")), lambda e: F.struct(e["key"].alias("type"), F.coalesce(e["value"], F.lit("")).alias("description")))
    only = kind == "function"  # others have neither
    return F.struct(name.alias("name"), kept.alias("properties"), F.when(only, F.coalesce(F.from_json(parts["imports"], "array<string>"), F.array())).otherwise(F.array().cast("array<string>")).alias("dependencies"), F.when(only, F.coalesce(constraints, F.array())).otherwise(F.array()).alias("constraints"))


@query("""WITH s AS (SELECT id, kind, content::JSON AS j FROM f_specifications) SELECT id, kind, COALESCE(j->>'$.name', CASE kind WHEN 'function' THEN 'unnamed_function' WHEN 'class' THEN 'UnnamedClass' WHEN 'module' THEN 'unnamed_module' WHEN 'interface' THEN 'UnnamedInterface' ELSE 'unnamed_behavior' END) AS name,
array_to_string(list_sort(list_filter(json_keys(j), lambda k: list_contains(CASE kind WHEN 'function' THEN ['parameters', 'return_type', 'visibility', 'async', 'documentation'] WHEN 'class' THEN ['inherits', 'implements', 'methods', 'fields', 'visibility'] WHEN 'module' THEN ['exports', 'imports', 'type']
WHEN 'interface' THEN ['methods', 'extends'] ELSE ['preconditions', 'postconditions', 'invariants', 'side_effects'] END, k))), ',') AS properties, CASE WHEN kind = 'function' THEN COALESCE(json_array_length(j->'$.imports'), 0) ELSE 0 END AS n_dependencies,
CASE WHEN kind = 'function' THEN COALESCE(array_to_string(list_sort(list_transform(json_keys(j->'$.constraints'), lambda k: k || '=' || (j->'$.constraints'->>k))), ','), '') ELSE '' END AS constraints FROM s""")
def t11_parsed_specifications(c):
    own = c.specifications.withColumn("x", parsed_specification(col("kind"), col("content")))
    constraints = F.array_join(F.array_sort(F.transform("x.constraints", lambda e: F.concat_ws("=", e["type"], e["description"]))), ",")
    return own.select("id", "kind", "x.name", F.array_join(F.array_sort(F.map_keys("x.properties")), ",").alias("properties"), F.size("x.dependencies").alias("n_dependencies"), constraints.alias("constraints"))


FN_LAYERS = CALLS + """, reach AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON e.s = r.t), bad AS (SELECT s AS id FROM reach WHERE s = t UNION SELECT s FROM reach WHERE t IN (SELECT s FROM reach WHERE s = t)),
w AS (SELECT id, 0 AS layer FROM fn WHERE id NOT IN (SELECT s FROM e) UNION SELECT e.s, w.layer + 1 FROM w JOIN e ON e.t = w.id WHERE e.s NOT IN (SELECT id FROM bad)), top AS (SELECT id, MAX(layer) AS layer FROM w GROUP BY id), l AS (SELECT * FROM top UNION ALL SELECT id, (SELECT MAX(layer) + 1 FROM top) FROM bad)"""


@query(f"""WITH RECURSIVE {FN_LAYERS}, n AS (SELECT id, container_id, position, COALESCE(semantic_name, 'unnamed') || '_' || position AS name FROM fn), body AS (SELECT e.s AS id, string_agg('    ' || n.name || '()', chr(10) ORDER BY n.position) AS body FROM e JOIN n ON n.id = e.t GROUP BY e.s)
SELECT n.container_id, string_agg('def ' || n.name || '():' || chr(10) || COALESCE(body.body, '    pass') || chr(10), '' ORDER BY l.layer, n.position) AS code FROM n JOIN l USING (id) LEFT JOIN body USING (id) GROUP BY n.container_id""")
def t13_composed_modules(c):
    """A module of each container: its functions, what is called before what calls it and cycles last, each with a name that no other has, so that every call means the function that it meant."""
    edges = calls(c)
    own = c.blocks.where(function()).select("id", "container_id", "position", F.concat(F.coalesce("semantic_name", F.lit("unnamed")), F.lit("_"), col("position").cast("string")).alias("name"))
    placed = layers(own.select(col("id").alias("node")), edges.select(col("t").alias("s"), col("s").alias("t")), whole=True).withColumnRenamed("node", "id")
    called = edges.join(own.select(col("id").alias("t"), "position", "name"), "t").groupBy(col("s").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("called"))
    body = F.coalesce(F.array_join(F.transform("called", lambda x: F.concat(F.lit("    "), x["name"], F.lit("()"))), "\n"), F.lit("    pass"))
    text = F.concat(F.lit("def "), "name", F.lit("():\n"), body, F.lit("\n"))
    rows = own.join(placed, "id").join(called, "id", "left").groupBy("container_id").agg(F.array_sort(F.collect_list(F.struct("layer", "position", text.alias("text")))).alias("parts"))
    return rows.select("container_id", F.array_join("parts.text", "").alias("code"))
