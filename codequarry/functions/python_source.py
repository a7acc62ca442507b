"""Blocks, relations, nodes and figures of Python sources, by the standard library's parser.

Sources are rows (path, content). A file is parsed by itself in a batch of files; files that don't
parse give no rows.
"""

from __future__ import annotations

import ast
import io
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCHES = (ast.If, ast.For, ast.While, ast.Try, ast.ExceptHandler, ast.Lambda)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SHOWN = {*FUNCTIONS, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Assign, ast.Call}
#: What a node adds to the complexity of what holds it; a try counts its handlers besides.
WEIGHTS = dict.fromkeys((ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.Compare), 1)
#: Fields with statements, and fields that hold neither statements nor expressions.
STATEMENTS, BARE = ("body", "orelse", "finalbody", "handlers", "cases"), {"ctx", "op", "ops", "id", "attr", "arg"}
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Files that a task parses before it hands their rows on.
SLICE = 200
#: Kinds of nodes as rows, by the parser's names.
NODES = {
    "FunctionDef": "function", "AsyncFunctionDef": "async_function", "ClassDef": "class", "Import": "import", "ImportFrom": "import", "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "assignment", "If": "if", "For": "for", "While": "while",
    "With": "with", "Try": "try", "ExceptHandler": "except", "Return": "return", "Raise": "raise", "Call": "call", "Lambda": "lambda",
}


def parsed(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def file_complexity(tree: ast.AST) -> int:
    """1, and 1 for every branch, lambda and further operand of and / or."""
    return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, BRANCHES) for n in ast.walk(tree))


def simple_complexity(tree: ast.AST) -> float:
    """Branches and definitions by all nodes, 1 at least."""
    nodes = list(ast.walk(tree))
    kinds = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert, ast.Try, ast.ClassDef, *FUNCTIONS)
    return max(1.0, sum(isinstance(n, kinds) for n in nodes) / max(1, len(nodes)))


def function_complexity(node: ast.AST) -> int:
    """1, and 1 for every branch, handler and comparison; a try counts its handlers once more."""
    nodes = list(ast.walk(node))
    return 1 + sum(isinstance(n, (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.BoolOp, ast.Compare)) for n in nodes) + sum(len(n.handlers) for n in nodes if isinstance(n, ast.Try))


@cache
def fields(kind: type) -> tuple[str, ...]:
    return tuple(x for x in kind._fields if x not in BARE)


def parts(node: ast.AST) -> list[ast.AST]:
    """The nodes right under node in order, without operators and contexts."""
    out = []
    for name in fields(type(node)):
        x = getattr(node, name, None)
        if isinstance(x, list):
            out += [y for y in x if isinstance(y, ast.AST)]
        elif isinstance(x, ast.AST):
            out.append(x)
    return out


def below(node: ast.AST, stop: tuple) -> Iterator[ast.AST]:
    """Nodes under node, in order; what stands inside a node of a kind in stop is left out."""
    work = [*ast.iter_child_nodes(node)][::-1]
    while work:
        x = work.pop()
        yield x
        if not isinstance(x, stop):
            work += [*ast.iter_child_nodes(x)][::-1]


def unparsed(node: ast.AST, text: str) -> str:
    """The node's source, written anew where it isn't too deep for that."""
    if isinstance(node, ast.Name):
        return node.id
    try:
        return ast.unparse(node)
    except RecursionError:
        return ast.get_source_segment(text, node) or ""


def called(node: ast.Call) -> str | None:
    return node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None


def one_return(node: ast.AST, text: str) -> str | None:
    """What a function returns, if that stands at one place of it, classes in it left out."""
    found, work = [], [node]
    while work:
        x = work.pop()
        if isinstance(x, ast.Return):
            found.append(x)
        elif not isinstance(x, ast.ClassDef):
            work += [y for name in STATEMENTS for y in getattr(x, name, ())]
    return (unparsed(found[0].value, text) if found[0].value else "") if len(found) == 1 else None


def blocks_of(text: str, tree: ast.Module, full: bool = True) -> tuple[list[dict], list[tuple[int, str, str]]]:
    """Blocks in pre-order, with the place of their parent and how many hold them; and relations by name (place, name, kind). Not full: with their nodes instead of texts, results, decorators and details."""
    out, relations, lines = [], [], list(io.StringIO(text, newline="")) if full else []

    def segment(node: ast.stmt) -> str:
        own = lines[node.lineno - 1 : node.end_lineno]
        own[-1] = own[-1].encode()[: node.end_col_offset].decode()
        own[0] = own[0].encode()[node.col_offset :].decode()
        return "".join(own)

    def add(node: ast.stmt, kind: str, name: str, parent: int | None) -> int:
        out.append({
            "position": len(out), "parent": parent, "depth": out[parent]["depth"] + 1 if parent is not None else 0, "block_type": kind, "name": name, "raw_text": segment(node) if full else None, "start_line": node.lineno, "end_line": node.end_lineno, "parameters": "[]", "return_type": None,
            "modifiers": "", "decorators": ",".join(unparsed(d, text) for d in getattr(node, "decorator_list", ())) if full else None, "complexity": 1 - weight, "details": None,
        })
        if not full:
            out[-1]["node"] = node
        work.append(len(out) - 1)
        return len(out) - 1

    def details(node: ast.stmt) -> str:
        inner = list(below(node, (ast.ClassDef,)))
        literal = {t.id: x.value.value for x in inner if isinstance(x, ast.Assign) and isinstance(x.value, ast.Constant) for t in x.targets if isinstance(t, ast.Name)}
        flow = [type(x).__name__.lower() for x in inner if isinstance(x, (ast.If, ast.For, ast.While, ast.Try, ast.With))]
        given = [unparsed(x.value, text) if x.value else "" for x in inner if isinstance(x, ast.Return)]
        return json.dumps({"assignments": literal, "control_flow": flow, "returns": given, "calls": [n for x in inner if isinstance(x, ast.Call) and (n := called(x))]}, default=str)

    weight = 0  # of the nodes so far; a block's complexity is what is added until its number comes up
    work: list = [(x, tree, None) for x in parts(tree)][::-1]  # node, the node that holds it, the block that does; or a block's number, once all below it is seen
    while work:
        top = work.pop()
        if isinstance(top, int):
            out[top]["complexity"] += weight
            continue
        x, holder, parent = top
        at = parent
        if type(x) not in SHOWN:  # most nodes
            pass
        elif isinstance(x, FUNCTIONS):
            at = add(x, "Function", x.name, parent)
            plain = [a.arg for a in (*x.args.posonlyargs, *x.args.args) if a.annotation is None]  # bare names only
            out[at] |= {"parameters": json.dumps(plain), "modifiers": "async" if isinstance(x, ast.AsyncFunctionDef) else ""}
            if full:
                out[at] |= {"return_type": unparsed(x.returns, text) if x.returns else None, "details": details(x)}
        elif isinstance(x, ast.ClassDef):
            at = add(x, "Class", x.name, parent)
            out[at]["bases"] = ", ".join(unparsed(b, text) for b in x.bases)
            relations.extend((at, b.id, "inherits") for b in x.bases if isinstance(b, ast.Name))
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            add(x, "Import", (x.module or ".") if isinstance(x, ast.ImportFrom) else x.names[0].name, parent)
        elif isinstance(x, ast.Assign) and isinstance(holder, ast.Module) and isinstance(x.targets[0], ast.Name):
            add(x, "Variable", x.targets[0].id, parent)
        elif isinstance(x, ast.Call) and parent is not None and (name := called(x)):
            relations.append((parent, name, "calls"))
        weight += len(x.handlers) if isinstance(x, ast.Try) else WEIGHTS.get(type(x), 0)
        work += [(y, x, at) for y in parts(x)][::-1]
    return out, relations


def stated(block: dict) -> str | None:
    """The one return that a block's details state."""
    given = json.loads(block["details"])["returns"] if block["details"] else []
    return given[0] if len(given) == 1 else None


def skeleton(blocks: list[dict], returned: Callable[[dict], str | None] = stated) -> str:
    """A source with the same imports, variables, classes and functions, whose bodies hold what is nested in them, or their one return, or nothing."""
    children: dict = {}
    for b in blocks:
        children.setdefault(b["parent"], []).append(b)
    out, work = [], [(b, 0) for b in children.get(None, ())][::-1]
    while work:
        b, depth = work.pop()
        pad, own = "    " * depth, children.get(b["position"], ())
        if b["block_type"] == "Import":
            out.append(f"{pad}import {b['name']}" if b["name"] != "." else f"{pad}from . import *")
        elif b["block_type"] == "Variable":
            out.append(f"{pad}{b['name']} = None")
        else:
            head = f"class {b['name']}{'(' + b['bases'] + ')' if b['bases'] else ''}:" if b["block_type"] == "Class" else f"{'async ' * (b['modifiers'] == 'async')}def {b['name']}({', '.join(json.loads(b['parameters']))}):"
            out.append(pad + head)
            if not own:
                given = returned(b) if b["block_type"] == "Function" else None
                out.append(f"{pad}    " + (f"return {given}" if given is not None and "\n" not in given else "pass"))
        work += [(x, depth + 1) for x in own][::-1]
    return "".join(f"{x}\n" for x in out)


def rebuilt(files: DataFrame) -> DataFrame:
    """path, original, generated (its skeleton), parses (the skeleton does), same: whether its blocks have the same kinds, names, places, parameters and complexity,
    and kept: how many of the original's tokens, repeats counted, stand in the skeleton."""
    seen = ("parent", "block_type", "name", "parameters", "complexity")

    def rows(path: str, text: str, tree: ast.Module) -> list[dict]:
        before, _ = blocks_of(text, tree, full=False)
        made = skeleton(before, lambda b: one_return(b["node"], text))
        again = parsed(made)
        after = blocks_of(made, again, full=False)[0] if again else []
        known = set(TOKEN.findall(made))
        return [{
            "original": text, "generated": made, "parses": again is not None, "same": again is not None and [[b[k] for k in seen] for b in before] == [[b[k] for k in seen] for b in after],
            "kept": sum(w in known for w in TOKEN.findall(text)),
        }]

    return by_file(files, rows, "path string, original string, generated string, parses boolean, same boolean, kept long")


def by_file(files: DataFrame, rows_of: Callable[[str, str, ast.Module], list[dict]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):  # trees and rows of a few files at a time
                part = batch.iloc[at : at + SLICE]
                rows = [{"path": path, **r} for path, text in zip(part["path"], part["content"], strict=True) if (tree := parsed(text)) for r in rows_of(path, text, tree)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism  # small inputs have few splits, parsing takes long
    return files.select("path", F.coalesce("content", F.lit("")).alias("content")).repartition(tasks, "path").mapInPandas(made, schema)


BLOCKS = "path string, position long, parent double, depth long, block_type string, name string, raw_text string, start_line long, end_line long, parameters string, return_type string, modifiers string, decorators string, complexity long, details string"


def blocks(files: DataFrame) -> DataFrame:
    return by_file(files, lambda path, text, tree: blocks_of(text, tree)[0], BLOCKS).withColumn("parent", F.col("parent").cast("long"))


def relations(files: DataFrame) -> DataFrame:
    """path, source, target (positions) and kind: names resolved to their last definition in the file; others are dropped."""
    named = by_file(files, lambda path, text, tree: [{"source": a, "name": n, "kind": k} for a, n, k in blocks_of(text, tree)[1]], "path string, source long, name string, kind string")
    defined = blocks(files).where("block_type IN ('Function', 'Class')").groupBy("path", "name").agg(F.max("position").alias("target"))
    return named.join(defined, ["path", "name"]).select("path", "source", "target", "kind").distinct()


def components(files: DataFrame) -> DataFrame:
    """In pre-order: functions and classes with the places of their first and last node and the class or function that holds them, and calls, bases, typed attributes and imports
    (name: what is called, derived from, typed as or imported) with the place where they stand."""

    def rows(path: str, text: str, tree: ast.Module) -> list[dict]:
        out: list[dict] = []
        work: list = [(x, None) for x in ast.iter_child_nodes(tree)][::-1]  # a node and the definition that holds it, or the number of a row that ends
        place = 0
        while work:
            x, holder = work.pop()
            if isinstance(x, int):
                out[x]["last"] = place
                continue
            place += 1
            row = lambda kind, name, at=place, holder=holder: {"kind": kind, "name": name, "place": at, "last": at, "parent": holder}
            inside = holder
            if isinstance(x, (*FUNCTIONS, ast.ClassDef)):
                out.append(row("class" if isinstance(x, ast.ClassDef) else "function", x.name))
                inside = place
                work.append((len(out) - 1, None))
                out += [row("base", unparsed(b, text), place) for b in getattr(x, "bases", ())]
            elif isinstance(x, ast.Call) and (name := called(x)):
                out.append(row("call", name))
            elif isinstance(x, ast.AnnAssign):
                typed = x.annotation.value if isinstance(x.annotation, ast.Subscript) else x.annotation
                out.append(row("attribute", unparsed(typed, text)))
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                out += [row("import", a.name) for a in x.names]
            work += [(y, inside) for y in ast.iter_child_nodes(x)][::-1]
        return out

    return by_file(files, rows, "path string, kind string, name string, place long, last long, parent double").withColumn("parent", F.col("parent").cast("long"))


def nodes(files: DataFrame) -> DataFrame:
    """Every node of the kinds in NODES: type, name, place and complexity."""

    def rows(path: str, text: str, tree: ast.Module) -> list[dict]:
        out = []
        for n in ast.walk(tree):
            if kind := NODES.get(type(n).__name__):
                name = getattr(n, "name", None) or (called(n) if isinstance(n, ast.Call) else None)
                out.append({"id": f"{path}:{n.lineno}:{n.col_offset}:{len(out)}", "type": kind, "name": name, "line": n.lineno, "col": n.col_offset, "end_line": n.end_lineno, "complexity": function_complexity(n) if isinstance(n, (*FUNCTIONS, ast.ClassDef)) else 1})
        return out

    return by_file(files, rows, "path string, id string, type string, name string, line long, col long, end_line long, complexity long")


def figures(files: DataFrame) -> DataFrame:
    """By file: imports, exports, classes, functions and variables (lists), complexities and lines."""

    def rows(path: str, text: str, tree: ast.Module) -> list[dict]:
        every = list(ast.walk(tree))
        imports = [a.asname or a.name if isinstance(n, ast.Import) else f"{n.module}.{a.asname or a.name}" if n.module else a.asname or a.name for n in every if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
        exports = [e.value for n in every if isinstance(n, ast.Assign) and isinstance(n.value, ast.List) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        targets = [t for n in every for t in (n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AnnAssign, ast.AugAssign)) else ())]
        variables = {x.id for t in targets for x in (t.elts if isinstance(t, ast.Tuple) else [t]) if isinstance(x, ast.Name)}
        classes = [n.name for n in below(tree, (ast.ClassDef,)) if isinstance(n, ast.ClassDef)]
        functions = [n.name for n in below(tree, FUNCTIONS) if isinstance(n, FUNCTIONS)]
        return [{"imports": imports, "exports": exports, "classes": classes, "functions": functions, "variables": sorted(variables), "complexity": float(file_complexity(tree)), "simple_complexity": simple_complexity(tree), "lines": text.count("\n") + 1}]

    lists = ", ".join(f"{k} array<string>" for k in ("imports", "exports", "classes", "functions", "variables"))
    return by_file(files, rows, f"path string, {lists}, complexity double, simple_complexity double, lines long")
