"""Files, sinks, extraction and streams on small inputs, against plain Python."""

import datetime
import itertools
import json

import pytest
from pyspark.sql import functions as F

from codequarry.functions import brace_source, python_source, source_text
from codequarry.operators import graph, scores
from codequarry.sources import files, sinks
from codequarry.streaming import changes

SAMPLE = '''import os, sys as system
from a.b import c as d
__all__ = ["Top", "run"]
LIMIT: int = 3
x, y = 1, 2

class Top(Base, Other):
    """doc"""
    def first(self, a, b: int = 1) -> str:
        if a and b and not x:
            for k in range(3):
                helper(k)
        return "s"

    async def second(self):
        try:
            return await self.first(1)
        except (ValueError, KeyError):
            raise
        finally:
            pass

def helper(k):
    def inner():
        return helper(k - 1)
    size = 3
    while k > 1:
        k -= 1
    return inner()

def helper(k, more):
    return lambda: k == more
'''


@pytest.fixture
def sample(spark):
    return spark.createDataFrame([("a.py", SAMPLE), ("bad.py", "def ("), ("empty.py", ""), ("none.py", None)], "path string, content string")


def test_python_blocks(sample):
    rows = [r for r in python_source.blocks(sample).orderBy("path", "position").collect() if r["path"] == "a.py"]
    assert [(r["block_type"], r["name"], r["parent"]) for r in rows] == [
        ("Import", "os", None), ("Import", "a.b", None), ("Variable", "__all__", None), ("Class", "Top", None), ("Function", "first", 3), ("Function", "second", 3), ("Function", "helper", None), ("Function", "inner", 6), ("Function", "helper", None),
    ]
    first, second, helper = rows[4], rows[5], rows[6]
    assert json.loads(first["parameters"]) == ["self", "a"] and first["return_type"] == "str" and second["modifiers"] == "async"
    # first: if, for, and-chain; second: handler, and once more for the try; helper: while, comparison
    assert [first["complexity"], second["complexity"], helper["complexity"]] == [4, 3, 3]
    details = json.loads(helper["details"])
    assert details["assignments"] == {"size": 3} and details["control_flow"] == ["while"] and details["calls"] == ["helper", "inner"]


def test_python_relations_resolve_to_the_last_definition(sample):
    made = {(r["source"], r["target"], r["kind"]) for r in python_source.relations(sample).collect()}
    assert made == {(4, 8, "calls"), (5, 4, "calls"), (7, 8, "calls"), (6, 7, "calls")}


def test_python_figures(sample):
    r = {r["path"]: r for r in python_source.figures(sample).collect()}
    assert set(r) == {"a.py", "empty.py", "none.py"}
    a = r["a.py"]
    assert a["imports"] == ["os", "system", "a.b.d"] and a["exports"] == ["Top", "run"] and a["classes"] == ["Top"]
    assert sorted(a["functions"]) == ["first", "helper", "helper", "second"] and a["variables"] == ["LIMIT", "__all__", "k", "size", "x", "y"]
    # if, for, two operands, try, handler, while, lambda
    assert a["complexity"] == 1 + 1 + 1 + 2 + 1 + 1 + 1 + 1 and r["empty.py"]["complexity"] == 1


def test_blocks_of_other_languages(spark):
    js = "import x from 'lib';\nimport './side';\nexport default class Big extends Small {\n  static async go(a) {\n    if (a) {\n    }\n  }\n}\nexport async function* walk(n) {\n}\nconst add = async (a, b) => a + b;\n"
    rust = "use std::{fs, io};\npub(crate) async fn run<T>(x: T) {\n    let y = File::open(x).unwrap();\n}\nimpl<T> Show for Thing<T> {\n    pub fn show(&mut self) {}\n}\nenum Kind { A }\n"
    df = spark.createDataFrame([("a", "typescript", js), ("b", "javascript", ""), ("c", "rust", None), ("d", "rust", rust)], "path string, language string, content string")
    found = {(r["path"], r["type"], r["name"]) for r in brace_source.nodes(df).collect()}
    assert found >= {("a", "import", "lib"), ("a", "import", "./side"), ("a", "class", "Big"), ("a", "method", "go"), ("a", "function", "walk"), ("a", "function", None)}
    assert found >= {("d", "import", "std::{fs,io}"), ("d", "function", "run"), ("d", "implementation", "Thing"), ("d", "function", "show"), ("d", "enum", "Kind")}
    r = df.where("path = 'd'").select(source_text.side_effects(F.col("content")).alias("e")).select("e.effect", source_text.purity(F.col("e")).alias("p")).first()
    assert r["effect"] == ["FileIO", "ExceptionThrowing"] and r["p"] == "Impure"


def test_files(spark, tmp_path):
    for path, content in {"a.py": b"x = 1", "pkg/__init__.py": b" \n", "pkg/b.rs": b"fn f() {}", "node_modules/c.js": b"1", "d.txt": b"no", "bad.py": b"\xff\xfe", "Dockerfile": b"FROM x", "e.ts": "é".encode()}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    made = {r["path"].split(f"{tmp_path}/")[1]: (r["language"], r["content"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert made == {"a.py": ("python", "x = 1"), "pkg/__init__.py": ("python", files.EMPTY_INIT), "pkg/b.rs": ("rust", "fn f() {}"), "Dockerfile": ("dockerfile", "FROM x"), "e.ts": ("typescript", "é")}
    names = lambda **k: [r["path"].rsplit("/", 1)[1] for r in files.discover(spark, str(tmp_path), **k).orderBy("path").collect()]
    assert names() == ["Dockerfile", "a.py", "bad.py", "e.ts", "__init__.py", "b.rs"]
    assert names(most_files=2) == ["Dockerfile", "a.py"] and names(total_bytes=12) == ["Dockerfile", "a.py"] and names(most_bytes=2) == ["bad.py", "e.ts", "__init__.py"]
    latin = files.raw(spark, f"{tmp_path}/bad.py").select(files.lenient(F.col("content")).alias("x")).first()["x"]
    assert latin["encoding"] == "latin1" and len(latin["text"]) == 2


def test_paths_and_addresses():
    assert files.checked_path("/tmp/x") == "/tmp/x" and files.checked_url("https://host.org/a.git")
    for bad in ("", "../x", "/etc/passwd", "a/../../b"):
        with pytest.raises(ValueError):
            files.checked_path(bad)
    for bad in ("", "ftp://x/y", "http://localhost/x", "https://127.0.0.1/x", "host.org"):
        with pytest.raises(ValueError):
            files.checked_url(bad)


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = lambda rows: spark.createDataFrame(rows, "id long, source_code string, language string")
    assert sinks.insert(table([(1, "a", "x"), (1, "b", "x"), (2, None, "y")]), path, ["id"]) == 2
    assert sinks.insert(table([(2, "z", "y"), (3, "c", "y")]), path, ["id"]) == 1
    own = spark.read.parquet(path).where("id > 1")
    plain = lambda df: sorted(map(tuple, df.collect()))
    changes = spark.createDataFrame([(2, "new", None), (9, "none", None)], "id long, source_code string, language string")
    assert plain(sinks.updated(own, changes, "id")) == [(2, "new", "y"), (3, "c", "y")]
    assert plain(sinks.upserted(own, table([(3, "d", "z"), (4, "e", "z")]), "id").where("id > 2")) == [(3, "d", "z"), (4, "e", "z")]
    now = F.lit(datetime.datetime(2024, 1, 31))
    kept = table([(1, "a", "x"), (2, None, "y")])
    backup = sinks.backed_up(kept, "b1", F.lit(datetime.datetime(2024, 1, 1)))
    assert plain(sinks.restored(sinks.eliminated(kept), backup, "b1").where("id = 1")) == [(1, "a", "x")]
    assert sinks.retained(backup, now, 40).count() == 1 and sinks.retained(backup, now, 20).count() == 0
    assert sinks.write_files(spark.createDataFrame([("x/a.txt", "one"), ("b.txt", None)], "path string, content string"), str(tmp_path / "out")) == 2
    assert (tmp_path / "out/x/a.txt").read_text() == "one"
    sinks.reset(kept, path)
    assert spark.read.parquet(path).count() == 0


def test_strong_components_against_tarjan(spark):
    import random

    rng = random.Random(3)
    edges = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(75))]
    df = spark.createDataFrame(edges, "s long, t long")
    found = graph.tarjan(edges)
    sizes = {x: sum(y == x for y in found.values()) for x in found.values()}
    expected = {(n, x, sizes[x]) for n, x in found.items() if sizes[x] > 1}
    assert expected
    for small in (graph.SMALL, 0):  # in tasks, and by rounds over whole tables
        assert {tuple(r) for r in graph.strong_components(df, small).collect()} == expected


def test_layers_omit_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6), (7, 7)], "s long, t long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 9)], "node long")
    assert {tuple(r) for r in graph.layers(nodes, df).collect()} == {(1, 0), (8, 0), (2, 1), (3, 2)}
    assert {r["node"] for r in graph.layers(nodes, df, whole=True).where("layer = 3").collect()} == {4, 5, 6, 7}


def test_syntax_rules(spark):
    rows = [("def f():\nreturn 1", "python"), ("def f()", "python"), ("let a = 1\nconst b = 2;\nvar c = {", "javascript"), ("fn f()", "rust"), ("let x = 1", "rust"), (" ", "rust"), ("x", "go"), ("class A:\n    x = 1\n", "python")]
    df = spark.createDataFrame(rows, "t string, l string").select(*scores.syntax_problems(F.col("t"), F.col("l")))
    assert [tuple(r) for r in df.collect()] == [(0, 1), (1, 0), (0, 1), (1, 0), (0, 1), (1, 0), (0, 1), (0, 0)]


def test_code_patterns(spark):
    single = "private constructor() {} static instance; getInstance() { return this.instance }"
    df = spark.createDataFrame([(single, "A"), ("return new X()", "ShapeFactory"), ("subscribe(x); listeners.add(x)", None), ("plain", "b")], "t string, n string")
    made = [[p["pattern"] for p in r[0]] for r in df.select(scores.patterns(F.col("t"), F.col("n"))).collect()]
    assert made == [["Singleton"], ["Factory"], ["Observer"], []]


def test_streams(spark, tmp_path):
    """Events in files, one a batch: windows and versions as over the whole table."""
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(k, k % 3, ("view", "error", "feature")[k % 3 if k % 4 else 1], t0 + datetime.timedelta(hours=7 * k)) for k in range(40)]
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    whole = spark.createDataFrame(rows, schema)
    for k, part in enumerate(itertools.batched(rows, 10)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def result(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert result(changes.weekly(stream()), "weekly", "complete") == sorted(map(tuple, changes.weekly(whole).collect()))
    expected, number = [], {}
    for event, user, kind, _ in rows:
        number[user] = number.get(user, 0) + changes.step_of(kind)
        expected.append((event, user, number[user]))
    assert result(changes.versions(stream()), "versions", "append") == expected
    late = spark.createDataFrame([(99, 0, "view", t0 - datetime.timedelta(days=90))], schema)
    late.write.mode("append").parquet(f"{tmp_path}/in/9")
    closed = result(changes.sessions(stream()), "sessions", "append")
    assert closed and set(closed) <= set(map(tuple, changes.sessions(whole.unionByName(late)).collect()))
