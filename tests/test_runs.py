"""Snapshots, observed figures, specifications and composed modules."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from codequarry.operators import synthesis
from codequarry.plans import lineage, registry
from codequarry.plans.observed import Observed, of_stream
from codequarry.sources import sinks
from codequarry.sources.snapshots import Snapshots, Taken

SF = "/root/testdata/sf0.001"


def names(snapshots, table="t"):
    own = snapshots.tables().get(table)
    return None if own is None else sorted(r["name"] for r in own.collect())


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert s.versions() == [] and s.tables() == {}
    assert s.run(lambda _: {"t": rows("a", "b"), "other": rows("x")}, {}) == (1, [])
    # a check that fails leaves readers on the old version and no new folders
    before = {x.name for x in (tmp_path / "s").iterdir()}
    fewer = {"rows": lambda old, new: old["t"].count() == new["t"].count(), "names": lambda old, new: True}
    assert s.run(lambda old: {"t": old["t"].where("name = 'a'")}, fewer) == (None, ["rows"])
    assert names(s) == ["a", "b"] and {x.name for x in (tmp_path / "s").iterdir()} == before
    # so does a job that dies while it writes
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|dies"):
        s.run(lambda old: {"t": old["t"].withColumn("name", F.when(F.col("name") == "b", F.raise_error(F.lit("dies"))).otherwise(F.col("name")))}, fewer)
    assert names(s) == ["a", "b"] and s.versions() == [1]
    # of two writers that began from one version, one publishes
    first, second = s.write({"t": rows("first")}), s.write({"t": rows("second")})
    assert s.publish(first, 1) == 2
    with pytest.raises(Taken):
        s.publish(second, 1)
    assert names(s) == ["first"] and all(x.suffix == ".crc" for x in (tmp_path / "s").glob(".manifest*"))
    # tables that a change leaves alone stay
    s.run(lambda old: {"other": rows("y")}, {})
    assert names(s) == ["first"] and names(s, "other") == ["y"] and s.versions() == [1, 2, 3]
    assert s.go_back(1) == 4 and names(s) == ["a", "b"] and names(s, "other") == ["x"]
    assert sorted(r["name"] for r in s.tables(2)["t"].collect()) == ["first"]


def test_observed_figures(spark):
    seen = Observed()
    own = seen.watch(spark.range(10), "all", n=F.count(F.lit(1)), total=F.sum("id"))
    few = seen.watch(own.where("id < 3"), "few", n=F.count(F.lit(1)), most=F.max(F.when(F.col("id") > 5, F.col("id"))))
    assert seen.run("count", lambda: few.collect())[0]["id"] == 0
    assert sorted(seen.rows()) == [("all", "n", 10.0), ("all", "total", 45.0), ("few", "most", None), ("few", "n", 3.0)] and seen.seconds["count"] > 0
    assert seen.frame(spark).count() == 4
    assert seen.within({("all", "n"): 5, ("few", "n"): 1, ("few", "most"): 9, ("none", "n"): 1}) == {("all", "n"): True, ("few", "n"): False, ("few", "most"): False, ("none", "n"): False}


def test_observed_figures_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 5).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    own = stream.observe("read", F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    q = own.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    rows = of_stream(q)
    assert sum(v for _, stage, k, v in rows if (stage, k) == ("read", "n")) == 15 and max(v for _, _, k, v in rows if k == "most" and v is not None) == 24


def test_written_folders_are_released(spark):
    df = lineage.written(spark.range(3), "gone")
    where = lineage.WRITTEN[-1]
    assert df.count() == 3
    lineage.release(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    assert not lineage.WRITTEN and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_files_are_written_by_address_or_path(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "one"), ("c.txt", None)], "path string, content string")
    assert sinks.write_files(rows, f"file://{tmp_path}/x") == 2 == sinks.write_files(rows, f"{tmp_path}/y")
    for top in "xy":
        assert (tmp_path / top / "a/b.txt").read_text() == "one" and (tmp_path / top / "c.txt").read_text() == ""
        assert sorted(p.name for p in (tmp_path / top).rglob("*.txt*")) == ["b.txt", "c.txt"]
    with pytest.raises(Exception, match="outside of the directory"):
        sinks.write_files(spark.createDataFrame([("../z", "")], "path string, content string"), f"file://{tmp_path}/x")


def test_specifications(spark):
    rows = [
        ("function", {"name": "f", "parameters": [1], "async": True, "fields": 1, "imports": ["a", "b"], "constraints": {"limit": "5", "none": None}}), ("function", {}), ("class", {"fields": {}, "imports": ["a"], "constraints": {"a": "b"}}),
        ("module", {"name": "m", "exports": None, "type": "x"}), ("interface", {"extends": "I", "name": ""}), ("behavior", {"side_effects": []}),
    ]
    df = spark.createDataFrame([(k, kind, json.dumps(x)) for k, (kind, x) in enumerate(rows)] + [(90, "class", None), (91, "class", "not JSON"), (92, "other", "{}"), (93, None, "[]")], "id long, kind string, content string")
    made = {r["id"]: r["x"] for r in df.select("id", synthesis.parsed_specification(F.col("kind"), F.col("content")).alias("x")).collect()}
    assert made[0]["name"] == "f" and sorted(made[0]["properties"]) == ["async", "parameters"] and made[0]["dependencies"] == ["a", "b"]
    assert sorted((c["type"], c["description"]) for c in made[0]["constraints"]) == [("limit", "5"), ("none", "")]
    assert [made[k]["name"] for k in (1, 2, 3, 4, 5, 90, 91, 92, 93)] == ["unnamed_function", "UnnamedClass", "m", "", "unnamed_behavior", "UnnamedClass", "UnnamedClass", None, None]
    assert made[2]["dependencies"] == [] == made[2]["constraints"] and sorted(made[3]["properties"]) == ["exports", "type"]


def test_composed_modules_parse_and_calls_keep_their_meaning(spark):
    c = registry.code(spark, SF)
    ids = {(r["container_id"], f"{r['name']}_{r['position']}"): r["id"] for r in c.blocks.where("block_type = 'Function'").selectExpr("container_id", "coalesce(semantic_name, 'unnamed') AS name", "position", "id").collect()}
    from codequarry.operators.graph import calls

    found = set()
    for r in registry.queries()["t13_composed_modules"](spark, SF).collect():
        tree, order = ast.parse(r["code"]), {}
        for f in tree.body:
            order[f.name] = len(order)
            found |= {(ids[r["container_id"], f.name], ids[r["container_id"], x.func.id]) for x in ast.walk(f) if isinstance(x, ast.Call)}
        assert len(order) == len(tree.body)  # no name twice
    assert found == {(r["s"], r["t"]) for r in calls(c).collect()}
