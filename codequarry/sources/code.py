"""Code tables (migrations, containers, blocks, relationships, versions, commits) as DataFrames over the driver's tables.

A Code holds the tables of one folder. Blocks carry their container's name, language, path and
migration, so that screens need no join; blocks and relationships are persisted (memory, then disk)
the first time that a query uses them, since many queries read them.
"""

from __future__ import annotations

from functools import cached_property, lru_cache, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of code blocks by supplier, and of names by part: the adapter's fixed values.
TEXTS = ("cursor.execute(SELECT + x)", "return eval(x)", "for a in b: for c in d: query(c)", "@app.route GET", "password = 1", "async def f(): pass", "if a: if b: if c: if d: pass", "open(path)")
KINDS = ("Class", "Import", "Variable", "Module", "Interface")
NAMES = ("test_", "get_api_key_", "UserFactory_", "RouteHandler_", "HandlerManager_")
LANGUAGES = ("python", "rust", "javascript", "typescript")
#: Source texts by language, # for the container's id.
SOURCES = {
    "python": "import os\nclass C#(Base):\n    def m(self, a):\n        if a:\n            return g(a)\n        return os.path\n\ndef g(x):\n    return x\n",
    "rust": "use std::fs;\nstruct S# {\n    a: i32,\n}\npub fn f#(x: i32) -> i32 {\n    println!(\"{}\", x);\n    x\n}\n",
    "javascript": "import { a } from './a';\nclass K# {\n  m(x) {\n    return x;\n  }\n}\nfunction f#(y) {\n  return y;\n}\n",
}
#: Files by language: head, a member (n times), middle, what opens a branch (d times), the leaves for d = 0, 1 and 2, what closes a branch, end; @ for the file's id.
#: Languages with braces have the same lines, whatever the text; Python's branches are indented.
FILES = {
    "python": ("import os\nclass C@(Base):\n", "    def m(self, a):\n        if a:\n            return g(a)\n        return os.path\n", "    k: D = 1\ndef g(x):\n", "", ("    return x\n", "    if x:\n        return x\n", "    if x:\n        if x:\n            return x\n"), "", "class D(C@):\n    def o(self):\n        def p(q):\n            return q\n        return p(1)\n"),
    "javascript": ("import { a } from './a';\n// } { \"\nclass K@ extends Base {\n", "  m(x, y) {\n    return \"}\" + `${x}{`;\n  }\n", "}\nfunction f@(y) {\n", "  if (y) {\n", ("  g(y);\n",) * 3, "  }\n", "}\n"),
    "typescript": ("import { a } from './a';\n/* } { */\nclass K@ implements I {\n", "  m(x: number, y: string): string {\n    return '}' + x;\n  }\n", "}\nfunction f@(y: boolean): void {\n", "  if (y) {\n", ("  g(y);\n",) * 3, "  }\n", "}\n"),
    "rust": ("use std::fs;\n/* { /* } */ { */\nimpl K@ {\n", "    pub fn m(&mut self, x: Vec<u8>) -> u8 {\n        println!(\"}\"); x[0]\n    }\n", "}\nfn f@<T: Clone>(y: T) -> i32 {\n", "    if y > 0 {\n", ("    g(y);\n", "    std::fs::read(y);\n", "    static mut Z: u8 = y.unwrap();\n"), "    }\n", "}\n"),
    "go": ("package p; import \"os\"\n// } {\ntype K@ struct {\n", "\ta int\n\tb string\n\tc []byte\n", "}\nfunc f@(y int) int {\n", "\tif y > 0 {\n", ("\tg(y)\n",) * 3, "\t}\n", "}\n"),
    "java": ("import java.util.List;\n/* } { */\nclass K@ {\n", "    public int m(List<String> x, int y) {\n        return \"}\".length() + y;\n    }\n", "}\nclass F@ { int f@(int y) {\n", "if (y > 0) {\n", ("g(y);\n",) * 3, "}\n", "}}\n"),
    "c": ("#include <stdio.h>\n/* } { */\nstruct K@ {\n", "    int a;\n    char b;\n    long c;\n", "};\nint f@(int y) {\n", "if (y > 0) {\n", ("g(y);\n",) * 3, "}\n", "}\n"),
}
#: Expressions by id, @ for the id; the fourth is repeated.
EXPRESSIONS = ("x + y * @", "f(x, y.z) ** 2 - g(h(x))", "a and not b or c.d.e > @", "", '[x, @, f(y)][i] if p < q <= r else {"k": v}', "obj.run(n=@, *rest) % -x ** -y")
#: Texts by id that show a pattern or break a principle, n for a part that is repeated, with their names.
SAMPLES = (
    ("Registry", "private static instance; constructor() {} static getInstance() { return Registry.instance; }", ""), ("WidgetFactory", "if (a) { return new A(); }", ""), ("Shop", "def make(kind): return a if kind else b; return c", ""),
    ("Feed", "subscribe(x) { this.listeners.push(x); } notify() { this.listeners.forEach(f => f()); }", ""), ("Manager", "class Manager: ", "def f(): pass; "), ("route", "", "if x: y; "), ("plain", "x = 1", ""),
)
#: What specifications say, by type.
SPECIFIED = (
    '"parameters": ["a", "b"], "async": true, "methods": [], "imports": ["x.y", "z"], "constraints": {"limit": "at most 5", "kind": "pure"}', '"inherits": "Base", "fields": {"a": 1}, "constraints": {"c": "d"}, "return_type": "int"', '"exports": ["f"], "type": "lib", "imports": []',
    '"methods": ["m"], "extends": null, "visibility": "public"', '"preconditions": ["p"], "invariants": [], "parameters": []',
)
#: Rows of relationships in a task that takes pairs once, and of blocks or relationships in one that joins by id.
EDGES = 200_000
CHANGES = {"view": "DocumentationAdded", "click": "DependencyAdded", "purchase": "TestAdded", "signup": "PatternIntroduced"}


def pick(of: Column, values, other=None) -> Column:
    """values[of], else other."""
    chain = reduce(lambda w, k: w.when(of == k, values[k]), range(1, len(values)), F.when(of == 0, values[0]))
    return chain.otherwise(F.lit(other)) if other is not None else chain


def text(column: str) -> Column:
    return F.col(column).cast("string")


class Code:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def kept(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def migrations(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("repository_name"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))

    @cached_property
    def containers(self) -> DataFrame:
        key = F.col("o_orderkey")
        written = F.when(key % 5 == 0, SOURCES["python"]).when(key % 5 == 1, SOURCES["rust"]).when(key % 5 < 4, SOURCES["javascript"]).otherwise("text #")
        source = F.when(key % 4 == 1, "").when(key % 4 != 0, F.replace(written, F.lit("#"), text("o_orderkey")))
        return self.table("orders").select(
            key.alias("id"),
            (F.col("o_custkey") % 5).cast("long").alias("migration_id"),
            F.concat(F.when(key % 9 == 0, "test_").otherwise("mod_"), text("o_orderkey")).alias("name"),
            pick(key % 5, LANGUAGES).alias("language"),
            F.concat(F.lit("src/pkg"), (F.col("o_custkey") % 20).cast("string"), F.lit("/f"), text("o_orderkey")).alias("original_path"),
            F.col("o_orderdate").alias("created_at"),
            source.alias("source_code"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """path (its id as text), language and content of files in seven languages, with n members and d nested branches."""
        key = F.col("o_orderkey")
        own = self.table("orders").select(text("o_orderkey").alias("path"), pick(key % 7, tuple(FILES)).alias("language"), (F.floor(key / 7) % 4).cast("int").alias("n"), (F.floor(key / 28) % 3).cast("int").alias("d"))
        part = lambda of: pick(F.col("path").cast("long") % 7, [of(x) for x in FILES.values()])
        leaf = pick(F.col("d"), [part(lambda x, k=k: F.lit(x[4][k])) for k in range(3)])
        written = F.concat(part(lambda x: F.lit(x[0])), F.repeat(part(lambda x: F.lit(x[1])), F.col("n")), part(lambda x: F.lit(x[2])), F.repeat(part(lambda x: F.lit(x[3])), F.col("d")), leaf, F.repeat(part(lambda x: F.lit(x[5])), F.col("d")), part(lambda x: F.lit(x[6])))
        return own.select("path", "language", F.replace(written, F.lit("@"), F.col("path")).alias("content"))

    @cached_property
    def expressions(self) -> DataFrame:
        """id and text of expressions, one for each container."""
        key = F.col("o_orderkey")
        chain = F.concat(F.repeat(F.lit("x + "), (key % 20).cast("int")), F.lit("y"))
        return self.table("orders").select(key.alias("id"), F.when(key % 6 == 3, chain).otherwise(F.replace(pick(key % 6, EXPRESSIONS), F.lit("@"), text("o_orderkey"))).alias("text"))

    @cached_property
    def imports(self) -> DataFrame:
        """id and imported: what the import blocks name, by part."""
        part = F.col("l_partkey")
        name = F.concat(F.when(part % 11 == 0, "zeta").otherwise("f"), (part % 500).cast("string"), pick(part % 3, ("", ".util", "x")))
        line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        return self.table("lineitem").withColumn("rn", F.row_number().over(line)).where(part % 8 == 1).select((F.col("l_orderkey") * 100 + F.col("rn")).alias("id"), name.alias("imported"))

    @cached_property
    def version_tree(self) -> DataFrame:
        """id, parent (null for the first), block_id and change_type of versions that branch."""
        key = F.col("event_id")
        return self.table("events").select(key.alias("id"), F.when(key > 0, F.floor((key - 1) / 3)).alias("parent"), (F.col("user_id") % 12).alias("block_id"), F.col("event_type").alias("change_type"))

    @cached_property
    def specifications(self) -> DataFrame:
        """id, kind and content (JSON) of specifications; every fifth has no name."""
        key = F.col("o_orderkey")
        kind = pick(key % 5, ("function", "class", "module", "interface", "behavior"))
        more = pick(key % 5, tuple(SPECIFIED))
        name = F.when(key % 25 < 5, F.lit("")).otherwise(F.concat(F.lit('"name": "n'), text("o_orderkey"), F.lit('", ')))
        return self.table("orders").select(key.alias("id"), kind.alias("kind"), F.concat(F.lit("{"), name, more, F.lit(', "more": '), text("o_orderkey"), F.lit("}")).alias("content"))

    @cached_property
    def backup(self) -> DataFrame:
        """id and saved: a copy of the containers' sources, of which some were lost and some changed."""
        lost, changed = F.col("id") % 97 == 2, F.col("id") % 89 == 3
        return self.containers.select("id", F.when(lost, "").when(changed, F.concat("source_code", F.lit(" "))).otherwise(F.col("source_code")).alias("saved"))

    @cached_property
    def samples(self) -> DataFrame:
        """id, name and text of SAMPLES; the part that is repeated stands id % 23 times."""
        key = F.col("o_orderkey")
        part = lambda k: pick(key % len(SAMPLES), [F.lit(x[k]) for x in SAMPLES])
        return self.table("orders").select(key.alias("id"), part(0).alias("name"), F.concat(part(1), F.repeat(part(2), (key % 23).cast("int"))).alias("text"))

    @cached_property
    def own_blocks(self) -> DataFrame:
        line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        rows = self.table("lineitem").withColumn("rn", F.row_number().over(line))
        part, supplier, amount = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
        n = (supplier % 8).cast("int")
        named = F.when(part % 8 == 1, part + 1).otherwise(part)  # an import is named as the next part
        return rows.select(
            (F.col("l_orderkey") * 100 + F.col("rn")).alias("id"),
            F.col("l_orderkey").alias("container_id"),
            pick(part % 8, KINDS, "Function").alias("block_type"),
            F.when(part % 17 != 0, F.concat(pick(named % 7, NAMES, "fn_"), (named % 500).cast("string"))).alias("semantic_name"),
            pick(supplier % 8, TEXTS).alias("raw_text"),
            F.col("rn").cast("int").alias("position"),
            F.when(F.col("rn") > 1, F.col("l_orderkey") * 100 + F.floor(F.col("rn") / 2)).alias("parent_block_id"),
            F.when(part % 19 != 0, amount).alias("cc"),
            (amount * 2).alias("loc"),
            (amount + n).alias("cognitive"),
            n.alias("n_params"),
            F.when(n == 0, "[]").otherwise(F.concat(F.lit('["p"'), F.repeat(F.lit(',"p"'), n - 1), F.lit("]"))).alias("parameters"),
            F.when(supplier % 3 == 0, "{}").alias("language_features"),
            F.when(supplier % 3 == 1, "{}").alias("body_ast"),
            F.when(part % 2 == 0, "int").alias("return_type"),
            (F.col("rn") % 4).cast("int").alias("indent"),
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """Blocks with their container's name (file_name), language, path and migration_id."""
        of = self.containers.select(F.col("id").alias("container_id"), F.col("name").alias("file_name"), "language", "original_path", "migration_id")
        return self.kept(self.own_blocks.join(of, "container_id"))

    @cached_property
    def relationships(self) -> DataFrame:
        """Rings within containers, chains and short cycles of containers, cycles of functions, and hubs."""
        b = self.blocks.select("id", "container_id", "position", "block_type").withColumn("n", F.count("*").over(Window.partitionBy("container_id")))
        here, linked = F.col("container_id"), F.col("container_id") % 7 != 3
        edge = lambda df, s, t, kind: df.select(s.alias("source_block_id"), t.alias("target_block_id"), kind.alias("relationship_type"))
        kind = F.when(here % 6 == 0, "depends_on").otherwise(pick(F.col("id") % 4, ("calls", "depends_on", "tests"), "imports"))
        ring = edge(b.where(((F.col("n") > 1) | (here % 6 == 0)) & linked), F.col("id"), here * 100 + F.col("position") % F.col("n") + 1, kind)
        first = b.where((F.col("position") == 1) & linked)
        ahead = lambda k: first.select(F.col("id").alias("other"), (here - k).alias("container_id"))
        chain = edge(first.where(here % 10 != 0).join(ahead(1), "container_id"), F.col("id"), F.col("other"), F.lit("calls"))
        back = edge(first.where(here % 20 == 4).join(ahead(2), "container_id"), F.col("other"), F.col("id"), F.lit("imports"))
        functions = b.where("block_type = 'Function'")
        looped = functions.where(here % 8 == 1).withColumn("k", F.count("*").over(Window.partitionBy("container_id")))
        order = Window.partitionBy("container_id").orderBy("position")
        next_one = F.coalesce(F.lead("id").over(order), F.first("id").over(order))
        loops = edge(looped.withColumn("other", next_one).where("k > 1"), F.col("id"), F.col("other"), F.lit("calls"))
        own = edge(functions.where(F.col("id") % 23 == 0), F.col("id"), F.col("id"), F.lit("calls"))
        hubs = first.where(here % 40 == 0).select(F.col("id").alias("hub"), here.alias("at"))
        near = first.where((here % 40).between(1, 30)).withColumn("at", here - here % 40).join(hubs, "at")
        to_hub = edge(near, F.col("id"), F.col("hub"), F.lit("references"))
        from_hub = edge(near.where((here % 40 <= 15) & (F.col("at") % 80 == 0)), F.col("hub"), F.col("id"), F.lit("references"))
        return self.kept(reduce(DataFrame.unionByName, (ring, chain, back, loops, own, to_hub, from_hub)))

    @cached_property
    def versions(self) -> DataFrame:
        kind = F.col("event_type")
        number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("block_id"), number.alias("version_number"), kind.alias("change_type"), (kind == "error").alias("breaking_change"), F.md5(kind.cast("binary")).alias("semantic_hash"), F.col("ts").alias("created_at"))

    @cached_property
    def changes(self) -> DataFrame:
        """Changes with their commit (one each): author and time."""
        kind = reduce(lambda w, x: w.when(F.col("event_type") == x, CHANGES[x]), list(CHANGES)[1:], F.when(F.col("event_type") == "view", CHANGES["view"])).otherwise("BugFixed")
        state = F.concat(F.lit('{"complexity_metrics":{"cyclomatic_complexity":'), F.get_json_object("props", "$.k"), F.lit("}}"))
        return self.table("events").select(F.col("event_id").alias("change_id"), F.col("event_id").alias("commit_id"), F.col("user_id").alias("block_id"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("author"), F.col("ts").alias("changed_at"), kind.alias("change_type"), state.alias("after_state"))

    @cached_property
    def edge_tasks(self) -> int:
        return 1 + self.relationships.count() // EDGES

    @cached_property
    def id_tasks(self) -> int:
        return max(self.edge_tasks, 1 + self.blocks.count() // EDGES)

    def dealt(self, df: DataFrame) -> DataFrame:
        """df by id, in tasks numbered by the rows of blocks and relationships and not by bytes."""
        return df.repartition(self.id_tasks, "id")

    def pairs(self, *kinds: str) -> DataFrame:
        """s and t of the relationships of some types (of all, if none is given), as often as they stand."""
        r = self.relationships.where(F.col("relationship_type").isin(*kinds)) if kinds else self.relationships
        return r.select(F.col("source_block_id").alias("s"), F.col("target_block_id").alias("t"))

    def edges(self, *kinds: str) -> DataFrame:
        """s and t of the relationships of some types (of all, if none is given), each pair once.

        Dealt to tasks by their number: ids compress so far that tasks sized by bytes would hold millions of pairs."""
        return self.pairs(*kinds).repartition(self.edge_tasks, "s", "t").distinct()


@lru_cache(maxsize=4)
def _code(spark: SparkSession, app: str, sf_dir: str) -> Code:
    return Code(spark, sf_dir)


def code(spark: SparkSession, sf_dir: str) -> Code:
    return _code(spark, spark.sparkContext.applicationId, sf_dir)
