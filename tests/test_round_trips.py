"""Python files written from their blocks: each is rebuilt once, and its texts stay in its own row."""

import ast

import pytest
from pyspark.sql import functions as F

from codequarry.functions import python_source
from codequarry.operators.scores import counted, quality, rated
from codequarry.plans import registry

SF = "/root/testdata/sf0.001"
NESTED = """import os, sys
@dec(1)
class A(os.x, B):
    def f(self, a: int, b, *c, d=lambda y: y or a < b):
        try:
            return [z for z in a if z and b] if a else (yield)
        except (E, F):
            while a < b < d:
                def g(x):
                    class H: pass
                    if x: return x
        except G: pass
        else:
            match a:
                case {"k": K(v)} if v: return v
    async def h(self):
        async def i(p, /, q): return (await p)(q)
V = not (os or sys)
"""


def times_rebuilt(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas")


def test_q07_rebuilds_each_file_once(spark):
    made = registry.queries()["q07_success_score"](spark, SF)
    assert times_rebuilt(made) == 1
    assert "InMemoryRelation" not in made._jdf.queryExecution().optimizedPlan().toString()  # whole blocks are not kept for two sums


def test_lean_blocks_are_those_of_whole_ones():
    tree = python_source.parsed(NESTED)
    full, relations = python_source.blocks_of(NESTED, tree)
    lean, same = python_source.blocks_of(NESTED, tree, full=False)
    assert relations == same
    assert len(full) == len(lean) == 8
    for x, y in zip(full, lean, strict=True):
        assert all(x[k] == y[k] for k in ("position", "parent", "depth", "block_type", "name", "parameters", "modifiers", "complexity"))
        assert y["complexity"] == python_source.function_complexity(y["node"])
        if isinstance(y["node"], python_source.FUNCTIONS):
            assert python_source.stated(x) == python_source.one_return(y["node"], NESTED)
    assert python_source.skeleton(full) == python_source.skeleton(lean, lambda b: python_source.one_return(b["node"], NESTED))
    assert ast.parse(python_source.skeleton(full))


def test_quality_in_a_files_own_row_is_that_of_dealt_tokens(spark):
    texts = ["", "\n", "x", "x = 1\n\n", "a = b\na = b\na = b\n", "import os\nimport os\n", "\u00a0 = 1", "'\u2003 \x85'\n\x0c\nv = 1\n \t\n", NESTED, NESTED * 3, "def f(: pass"]
    files = spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)], "path string, content string")
    made = python_source.rebuilt(files).withColumnsRenamed({"original": "a", "generated": "b"})
    own = made.select("path", *counted(), "kept").withColumn("quality", rated(F.col("kept")))
    found, wanted = ({r["path"]: r["quality"] for r in x.collect()} for x in (own, quality(made.select(F.col("path").alias("id"), "a", "b")).withColumnRenamed("id", "path")))
    assert found == pytest.approx(wanted, abs=1e-9)
    assert len(found) == 9 and found["0"] == 1.0 and found["5"] == 1.0


def test_x07_rebuilds_each_file_once(spark):
    made = registry.queries()["x07_elimination_run"](spark, SF)
    assert times_rebuilt(made) == 1


def test_q23_rebuilds_each_file_once(spark):
    made = registry.queries()["q23_pipeline_success"](spark, SF)
    assert times_rebuilt(made) == 1
