"""Diffs, merges, merge bases, import resolution and enclosing spans against brute force."""

import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest

from codequarry.functions import merging
from codequarry.operators import components, merges


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_scripts_are_least_and_replay():
    r = random.Random(1)
    for _ in range(5_000):
        a, b = ([r.choice("abcd"[: r.randrange(1, 5)]) for _ in range(r.randrange(12))] for _ in range(2))
        found = merging.matches(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found) and found == sorted(found)
        edits = merging.script(a, b)
        assert len(edits) == len(a) + len(b) - 2 * len(found) and merging.replayed(a, b, edits) == b


def test_long_texts_with_few_edits_in_seconds():
    r = random.Random(2)
    a = [str(r.randrange(1_000)) for _ in range(100_000)]
    b = [x for k, x in enumerate(a) if k % 997] + ["new"]
    began = time.process_time()
    edits = merging.script(a, b)
    assert len(edits) == len(a) - len(b) + 2 and merging.replayed(a, b, edits) == b
    assert time.process_time() - began < 30


def test_three_way_merges(spark):
    base = list("abcdefgh")
    cases = [
        (base, list("aBcdefgh"), list("abcdefGh"), "aBcdefGh", []),  # apart
        (base, list("aBcdefgh"), list("aBcdefgh"), "aBcdefgh", []),  # alike
        (base, list("aBcdefgh"), list("aXcdefgh"), "abcdefgh", [(1, 2, ["B"], ["X"])]),
        (base, list("acdefgh"), list("aXcdefgh"), "abcdefgh", [(1, 2, [], ["X"])]),  # dropped and changed
        (base, list("abcdefghij"), list("zabcdefgh"), "zabcdefghij", []),
        ([], ["x"], ["y"], "", [(0, 0, ["x"], ["y"])]),
        ([], [], [], "", []),
    ]
    for before, ours, theirs, wanted, conflicts in cases:
        assert merging.merged(before, ours, theirs) == (list(wanted), conflicts)
    rows = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(cases)] + [(None, None, ["a"], None)], "id long, base array<string>, ours array<string>, theirs array<string>")
    made = {r["id"]: r for r in merging.merges(rows).collect()}
    assert all("".join(made[k]["merged"]) == x[3] and len(made[k]["conflicts"]) == len(x[4]) for k, x in enumerate(cases)) and made[None]["merged"] == ["a"]
    assert (made[2]["conflicts"][0]["from"], made[2]["conflicts"][0]["theirs"]) == (1, ["X"])


def test_merges_with_the_base_give_the_other_side():
    r = random.Random(3)
    for _ in range(2_000):
        base, other = ([r.choice("abc") for _ in range(r.randrange(10))] for _ in range(2))
        assert merging.merged(base, base, other) == (other, []) == merging.merged(base, other, base) == merging.merged(base, other, other)


def test_merge_bases_of_random_trees_and_a_chain(spark):
    r = random.Random(4)
    parent = {k: r.randrange(max(0, k - 4), k) if k not in (0, 150) else None for k in range(300)}  # two trees
    parent |= {1_000 + k: 1_000 + k - 1 if k else None for k in range(3_000)}  # and a chain of 3,000

    def way(x):
        out = []
        while x is not None:
            out.append(x)
            x = parent[x]
        return out

    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(3_999, 1_000), (1_500, 3_700), (5, 1_001), (7, 7)]
    wanted = {(a, b): next((x for x in way(a) if x in set(way(b))), None) for a, b in pairs}
    tree = spark.createDataFrame(list(parent.items()), "id long, parent long")
    made = merges.merge_bases(tree, spark.createDataFrame(pairs, "ours long, theirs long")).collect()
    assert {(x["ours"], x["theirs"]): x["base"] for x in made} == wanted
    roots = spark.createDataFrame([(1, None), (2, None)], "id long, parent long")
    assert {(x["ours"], x["theirs"]): x["base"] for x in merges.merge_bases(roots, spark.createDataFrame([(1, 2), (1, 1)], "ours long, theirs long")).collect()} == {(1, 2): None, (1, 1): 1}


def test_resolved_imports(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("ab", k=r.randrange(0, 6)))
    files = [(k, f"src/{word()}{'.py' if k % 2 else ''}", r.randrange(5)) for k in range(40)] + [(100, "x/.hidden", 0), (101, "y/a.b.c", 0), (102, "q" * 400 + "/common", 9)]
    imports = [(k, word() + r.choice(["", "z", ".a"])) for k in range(200)] + [(300, None), (301, "hidden"), (302, "some.a.b.thing"), (303, "w" * 300), (304, "é common é")]
    stem = lambda p: (n := p.rsplit("/", 1)[-1])[: n.rindex(".")] if "." in (n := p.rsplit("/", 1)[-1])[1:] else n
    wanted = {}
    for k, name in imports:
        hits = sorted((at, f) for f, p, at in files if name is not None and (stem(p) in name or name in stem(p)))
        if hits:
            wanted[k] = hits[0][1]
    made = components.resolved(spark.createDataFrame(imports, "id long, imported string"), spark.createDataFrame(files, "file_id long, path string, created_at long")).collect()
    assert {x["id"]: x["file_id"] for x in made} == wanted
    none = spark.createDataFrame([], "file_id long, path string, created_at long")
    assert components.resolved(spark.createDataFrame(imports, "id long, imported string"), none).collect() == []


def nested(r, begin, room, parent, out):
    while room > 2 and r.random() < 0.7:
        size = r.randrange(1, room)
        out.append((begin, begin + size - 1, parent))
        nested(r, begin + 1, size - 1, begin, out)
        begin, room = begin + size, room - size


@pytest.mark.parametrize("seed", range(3))
def test_innermost_spans(spark, seed):
    r, spans, points = random.Random(seed), [], []
    for path in ("a", "b"):
        own = []
        nested(r, 1, 60, None, own)
        spans += [(path, *x) for x in own]
        points += [(path, f"p{k}", k) for k in range(65)]
    points.append(("none", "x", 3))
    made = components.innermost(spark.createDataFrame(spans, "path string, place long, last long, parent long"), spark.createDataFrame(points, "path string, name string, place long")).collect()
    wanted = {(p, n): max((s[1] for s in spans if s[0] == p and s[1] <= at <= s[2]), default=None) for p, n, at in points}
    assert {(x["path"], x["name"]): x["holder"] for x in made} == wanted


def test_component_relationships(spark):
    text = "import os, sys as s\nfrom a.b import c\nclass A: pass\nclass B(A, Other):\n    part: A = None\n    parts: A[int] = None\n    def run(self):\n        def inner():\n            help(1)\n        inner(); help(2); obj.run()\n        x: B = 1\ndef help(x):\n    return help(x)\nhelp(3)\n"
    made = {tuple(x) for x in components.relationships(spark.createDataFrame([("f", text), ("g", "help()"), ("broken", "def (")], "path string, content string")).collect()}
    rows = [("f", "f", n, "Import", 2, False) for n in ("os", "sys", "c")] + [("f", "B", "A", "Inheritance", 10, True), ("f", "B", "A", "Composition", 8, True), ("f", "run", "B", "Composition", 8, True)]
    rows += [("f", a, b, "FunctionCall", 5, True) for a, b in (("inner", "help"), ("run", "inner"), ("run", "help"), ("run", "run"), ("help", "help"), ("f", "help"))]
    assert made == set(rows)


def test_rows_are_handed_on_in_slices(monkeypatch):
    from codequarry.functions import merging, python_source

    monkeypatch.setattr(python_source, "SLICE", 2)
    monkeypatch.setattr(merging, "SLICE", 2)
    taken = []
    files = SimpleNamespace(mapInPandas=lambda made, schema: taken.append(made))
    files.select = files.repartition = lambda *x: files
    files.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=1))
    monkeypatch.setattr(python_source, "F", SimpleNamespace(coalesce=lambda *x: SimpleNamespace(alias=lambda y: y), lit=str))
    python_source.by_file(files, lambda path, text, tree: [{"n": 1}], "path string, n long")
    batch = pd.DataFrame({"path": list("abcde"), "content": ["x = 1", "x = (", "k = 2", "y", "z"]})
    assert [x["path"].tolist() for x in taken[0](iter([batch]))] == [["a"], ["c", "d"], ["e"]]
    monkeypatch.setattr(merging, "F", SimpleNamespace(coalesce=lambda *x: SimpleNamespace(alias=lambda y: y), array=lambda: SimpleNamespace(cast=str)))
    merging.merges(files)
    texts = pd.DataFrame({"id": range(5), **{k: [["x"]] * 5 for k in ("base", "ours", "theirs")}})
    assert [len(x) for x in taken[1](iter([texts]))] == [2, 2, 1]
