"""The code tables as SQL that DuckDB runs: what the oracles read. The engine builds its own in sources/code.py."""

from __future__ import annotations

from codequarry.sources.code import FILES, SAMPLES, SPECIFIED


def _file_part(of) -> str:
    """The part of a file's text by its language (k), as SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "CASE k " + " ".join(f"WHEN {k} THEN {quoted(of(x))}" for k, x in enumerate(FILES.values())) + " END"


_LEAF = "CASE d " + " ".join(f"WHEN {i} THEN {_file_part(lambda x, i=i: x[4][i])}" for i in range(3)) + " END"

#: In order; each may use the ones before.
VIEWS = {
    "f_migrations": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS repository_name, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM region",
    "f_containers": """SELECT o_orderkey AS id, CAST(o_custkey % 5 AS BIGINT) AS migration_id,
  CASE WHEN o_orderkey % 9 = 0 THEN 'test_' ELSE 'mod_' END || CAST(o_orderkey AS VARCHAR) AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'javascript' WHEN 3 THEN 'typescript' ELSE NULL END AS language,
  'src/pkg' || CAST(o_custkey % 20 AS VARCHAR) || '/f' || CAST(o_orderkey AS VARCHAR) AS original_path, o_orderdate AS created_at,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE replace(CASE o_orderkey % 5 WHEN 0 THEN 'import os
class C#(Base):
    def m(self, a):
        if a:
            return g(a)
        return os.path

def g(x):
    return x
' WHEN 1 THEN 'use std::fs;
struct S# {
    a: i32,
}
pub fn f#(x: i32) -> i32 {
    println!("{}", x);
    x
}
' WHEN 4 THEN 'text #' ELSE 'import { a } from ''./a'';
class K# {
  m(x) {
    return x;
  }
}
function f#(y) {
  return y;
}
' END, '#', CAST(o_orderkey AS VARCHAR)) END AS source_code FROM orders""",
    "f_files": f"""SELECT path, language, n, d, replace({_file_part(lambda x: x[0])} || repeat({_file_part(lambda x: x[1])}, n) || {_file_part(lambda x: x[2])} || repeat({_file_part(lambda x: x[3])}, d) || {_LEAF} || repeat({_file_part(lambda x: x[5])}, d) || {_file_part(lambda x: x[6])}, '@', path) AS content
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 7 AS k, (['{"', '".join(FILES)}'])[o_orderkey % 7 + 1] AS language, CAST(o_orderkey // 7 % 4 AS INT) AS n, CAST(o_orderkey // 28 % 3 AS INT) AS d FROM orders)""",
    # what stands in files with braces: members, the class around the function in Java, its first line and its place among the nodes
    "f_layout": """SELECT *, CASE WHEN language IN ('javascript', 'typescript', 'rust', 'java') THEN n ELSE 0 END AS m, CAST(language = 'java' AS INT) AS w, CAST(language = 'go' AS INT) AS g FROM f_files WHERE language <> 'python'""",
    "f_nodes": """SELECT l.path, l.language, position, parent, level, s.kind, CASE s.slot WHEN 'package' THEN 'p' WHEN 'import' THEN CASE l.language WHEN 'c' THEN '<stdio.h>' WHEN 'rust' THEN 'std::fs' WHEN 'go' THEN 'os' WHEN 'java' THEN 'java.util.List' ELSE './a' END WHEN 'type' THEN 'K' || path WHEN 'member' THEN 'm' WHEN 'wrap' THEN 'F' || path WHEN 'function' THEN 'f' || path END AS name, s.slot, line, end_line FROM (
  SELECT *, 'package' AS slot, 0 AS position, NULL AS parent, 0 AS level, 1 AS line, 1 AS end_line FROM f_layout WHERE g = 1
  UNION ALL SELECT *, 'import', g, NULL, 0, 1, 1 FROM f_layout
  UNION ALL SELECT *, 'type', g + 1, NULL, 0, 3, 4 + 3 * n FROM f_layout
  UNION ALL SELECT path, language, n, d, content, m, w, g, 'member', g + 2 + i, g + 1, 1, 4 + 3 * i, 6 + 3 * i FROM (SELECT *, unnest(range(m)) AS i FROM f_layout)
  UNION ALL SELECT *, 'wrap', g + 2 + m, NULL, 0, 5 + 3 * n, 7 + 3 * n + 2 * d FROM f_layout WHERE w = 1
  UNION ALL SELECT *, 'function', g + 2 + m + w, CASE w WHEN 1 THEN g + 2 + m END, w, 5 + 3 * n, 7 + 3 * n + 2 * d FROM f_layout
  UNION ALL SELECT path, language, n, d, content, m, w, g, 'branch', g + 3 + m + w + j, g + 2 + m + w + j, w + 1 + j, 6 + 3 * n + j, 6 + 3 * n + 2 * d - j FROM (SELECT *, unnest(range(d)) AS j FROM f_layout)) l
JOIN (VALUES ('javascript', 'import', 'import_statement'), ('javascript', 'type', 'class_declaration'), ('javascript', 'member', 'method_definition'), ('javascript', 'function', 'function_declaration'), ('javascript', 'branch', 'if_statement'),
  ('typescript', 'import', 'import_statement'), ('typescript', 'type', 'class_declaration'), ('typescript', 'member', 'method_definition'), ('typescript', 'function', 'function_declaration'), ('typescript', 'branch', 'if_statement'),
  ('rust', 'import', 'use_declaration'), ('rust', 'type', 'impl_item'), ('rust', 'member', 'function_item'), ('rust', 'function', 'function_item'), ('rust', 'branch', 'if_expression'),
  ('go', 'package', 'package_clause'), ('go', 'import', 'import_declaration'), ('go', 'type', 'type_declaration'), ('go', 'function', 'function_declaration'), ('go', 'branch', 'if_statement'),
  ('java', 'import', 'import_declaration'), ('java', 'type', 'class_declaration'), ('java', 'member', 'method_declaration'), ('java', 'wrap', 'class_declaration'), ('java', 'function', 'method_declaration'), ('java', 'branch', 'if_statement'),
  ('c', 'import', 'preproc_include'), ('c', 'type', 'struct_specifier'), ('c', 'function', 'function_definition'), ('c', 'branch', 'if_statement')) s(language, slot, kind) ON s.language = l.language AND s.slot = l.slot""",
    "f_expressions": """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'x + y * @' WHEN 1 THEN 'f(x, y.z) ** 2 - g(h(x))' WHEN 2 THEN 'a and not b or c.d.e > @' WHEN 3 THEN repeat('x + ', CAST(o_orderkey % 20 AS INT)) || 'y' WHEN 4 THEN '[x, @, f(y)][i] if p < q <= r else {"k": v}'
  ELSE 'obj.run(n=@, *rest) % -x ** -y' END AS text FROM orders""",
    "f_backup": "SELECT id, CASE WHEN id % 97 = 2 THEN '' WHEN id % 89 = 3 THEN source_code || ' ' ELSE source_code END AS saved FROM f_containers",
    "f_samples": f"""SELECT o_orderkey AS id, s.name, s.head || repeat(s.more, CAST(o_orderkey % 23 AS INT)) AS t FROM orders JOIN (VALUES {", ".join(str((k, *x)) for k, x in enumerate(SAMPLES))}) s(k, name, head, more) ON s.k = o_orderkey % {len(SAMPLES)}""",
    # Python files and their skeletons
    "f_rebuilt": """SELECT path, migration_id, n, d, content AS a, 'import os' || chr(10) || 'class C' || path || '(Base):' || chr(10) || CASE n WHEN 0 THEN '    pass' || chr(10) ELSE repeat('    def m(self, a):' || chr(10) || '        pass' || chr(10), n) END || 'def g(x):' || chr(10) || '    return x' || chr(10)
  || 'class D(C' || path || '):' || chr(10) || '    def o(self):' || chr(10) || '        def p(q):' || chr(10) || '            return q' || chr(10) AS b FROM f_files JOIN f_containers c ON CAST(c.id AS VARCHAR) = path WHERE f_files.language = 'python'""",
    "f_numbered": "SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem",
    "f_raw": """SELECT l_orderkey * 100 + rn AS id, l_orderkey AS container_id,
  CASE l_partkey % 8 WHEN 0 THEN 'Class' WHEN 1 THEN 'Import' WHEN 2 THEN 'Variable' WHEN 3 THEN 'Module' WHEN 4 THEN 'Interface' ELSE 'Function' END AS block_type,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CASE (l_partkey + CAST(l_partkey % 8 = 1 AS INT)) % 7 WHEN 0 THEN 'test_' WHEN 1 THEN 'get_api_key_' WHEN 2 THEN 'UserFactory_' WHEN 3 THEN 'RouteHandler_' WHEN 4 THEN 'HandlerManager_' ELSE 'fn_' END || CAST((l_partkey + CAST(l_partkey % 8 = 1 AS INT)) % 500 AS VARCHAR) END AS semantic_name,
  CASE l_suppkey % 8 WHEN 0 THEN 'cursor.execute(SELECT + x)' WHEN 1 THEN 'return eval(x)' WHEN 2 THEN 'for a in b: for c in d: query(c)' WHEN 3 THEN '@app.route GET' WHEN 4 THEN 'password = 1' WHEN 5 THEN 'async def f(): pass' WHEN 6 THEN 'if a: if b: if c: if d: pass' ELSE 'open(path)' END AS raw_text,
  CAST(rn AS INT) AS position, CASE WHEN rn = 1 THEN NULL ELSE l_orderkey * 100 + rn // 2 END AS parent_block_id,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS cc, CAST(l_quantity AS INT) * 2 AS loc, CAST(l_quantity AS INT) + CAST(l_suppkey % 8 AS INT) AS cognitive, CAST(l_suppkey % 8 AS INT) AS n_params,
  CASE WHEN l_suppkey % 8 = 0 THEN '[]' ELSE '["p"' || repeat(',"p"', CAST(l_suppkey % 8 - 1 AS INT)) || ']' END AS parameters,
  CASE WHEN l_suppkey % 3 = 0 THEN '{}' END AS language_features, CASE WHEN l_suppkey % 3 = 1 THEN '{}' END AS body_ast, CASE WHEN l_partkey % 2 = 0 THEN 'int' END AS return_type, CAST(rn % 4 AS INT) AS indent FROM f_numbered""",
    "f_blocks": "SELECT b.*, len(string_split(b.parameters, ',')) AS param_count, c.name AS file_name, c.language, c.original_path, c.migration_id FROM f_raw b JOIN f_containers c ON b.container_id = c.id",
    "f_counted": "SELECT id, container_id, position, block_type, COUNT(*) OVER (PARTITION BY container_id) AS n FROM f_raw",
    "f_relationships": """SELECT id AS source_block_id, container_id * 100 + (position % n) + 1 AS target_block_id,
  CASE WHEN container_id % 6 = 0 THEN 'depends_on' ELSE CASE (id % 4) WHEN 0 THEN 'calls' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'tests' ELSE 'imports' END END AS relationship_type
FROM f_counted WHERE (n > 1 OR container_id % 6 = 0) AND container_id % 7 <> 3
UNION ALL SELECT a.id AS source_block_id, b.id AS target_block_id, 'calls' AS relationship_type
FROM f_raw a JOIN f_raw b ON b.container_id = a.container_id + 1
WHERE a.position = 1 AND b.position = 1 AND a.container_id % 10 <> 0 AND a.container_id % 7 <> 3 AND b.container_id % 7 <> 3
UNION ALL SELECT b.id, a.id, 'imports' FROM f_raw a JOIN f_raw b ON b.container_id = a.container_id + 2 WHERE a.position = 1 AND b.position = 1 AND a.container_id % 20 = 4 AND a.container_id % 7 <> 3 AND b.container_id % 7 <> 3
UNION ALL SELECT id, other, 'calls' FROM (SELECT id, COALESCE(LEAD(id) OVER w, FIRST_VALUE(id) OVER w) AS other, COUNT(*) OVER (PARTITION BY container_id) AS k FROM f_raw WHERE block_type = 'Function' AND container_id % 8 = 1 WINDOW w AS (PARTITION BY container_id ORDER BY position)) WHERE k > 1
UNION ALL SELECT id, id, 'calls' FROM f_raw WHERE block_type = 'Function' AND id % 23 = 0
UNION ALL SELECT a.id, h.id, 'references' FROM f_raw a JOIN f_raw h ON h.container_id = a.container_id - a.container_id % 40 WHERE a.position = 1 AND h.position = 1 AND a.container_id % 7 <> 3 AND h.container_id % 7 <> 3 AND a.container_id % 40 BETWEEN 1 AND 30
UNION ALL SELECT h.id, a.id, 'references' FROM f_raw a JOIN f_raw h ON h.container_id = a.container_id - a.container_id % 40 WHERE a.position = 1 AND h.position = 1 AND a.container_id % 7 <> 3 AND h.container_id % 7 <> 3 AND a.container_id % 40 BETWEEN 1 AND 15 AND h.container_id % 80 = 0""",
    "f_imports": "SELECT id, CASE WHEN l_partkey % 11 = 0 THEN 'zeta' ELSE 'f' END || CAST(l_partkey % 500 AS VARCHAR) || CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.util' ELSE 'x' END AS imported FROM (SELECT l_orderkey * 100 + rn AS id, l_partkey FROM f_numbered WHERE l_partkey % 8 = 1)",
    "f_tree": "SELECT event_id AS id, CASE WHEN event_id > 0 THEN (event_id - 1) // 3 END AS parent, user_id % 12 AS block_id, event_type AS change_type FROM events",
    "f_specifications": f"""SELECT o_orderkey AS id, k.kind, '{{' || CASE WHEN o_orderkey % 25 < 5 THEN '' ELSE '"name": "n' || o_orderkey || '", ' END || k.more || ', "more": ' || o_orderkey || '}}' AS content
FROM orders JOIN (VALUES {", ".join(str((i, kind, more)) for i, (kind, more) in enumerate(zip(("function", "class", "module", "interface", "behavior"), SPECIFIED, strict=True)))}) k(i, kind, more) ON k.i = o_orderkey % 5""",
    "f_versions": """SELECT event_id AS id, user_id AS block_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version_number,
  event_type AS change_type, event_type = 'error' AS breaking_change, md5(event_type) AS semantic_hash, ts AS created_at FROM events""",
    "f_changes": """SELECT event_id AS change_id, event_id AS commit_id, user_id AS block_id, 'u' || CAST(user_id % 10 AS VARCHAR) AS author, ts AS changed_at, CASE event_type WHEN 'view' THEN 'DocumentationAdded' WHEN 'click' THEN 'DependencyAdded'
  WHEN 'purchase' THEN 'TestAdded' WHEN 'signup' THEN 'PatternIntroduced' ELSE 'BugFixed' END AS change_type, CAST(json_extract(props, '$.k') AS INT) AS cc_after FROM events""",
}
BASE = ("region", "orders", "lineitem", "events", "documents", "conversations", "pages", "nation", "part")


def with_views(query: str) -> str:
    """query behind those of the views that it needs, as one statement."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in needed:
                need(body)
                needed.append(name)

    need(query)
    more = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed]
    if query.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*more, query.removeprefix("WITH RECURSIVE ")])
    if more and query.startswith("WITH "):
        return "WITH " + ", ".join([*more, query.removeprefix("WITH ")])
    return "WITH " + ", ".join(more) + " " + query if more else query
