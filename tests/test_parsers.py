"""Parsers against trees made by hand, against Python's own parser, and on files that are broken or very deep."""

import ast
import random

import pytest

from codequarry.functions import brace_source, expressions, python_source

SCRIPT = """import { a } from './a';
// braces } in { comments
class K extends L {
  static async m(x, y = {a: 1}) {
    return `}${x + `{${y}`}` + "}";
  }
  get v() { return /[}/]{2}/.test(this.x) ? 1 : 2 }
}
export default function f(y) {
  if (y) {
    g(y);
  } else if (z) {
    h();
  } else {
    k()
  }
  for (let i = 0; i < 3; i++) if (i) q(i);
  do { x++ } while (x < 3);
  try { a() } catch (e) { b() } finally { c() }
}
const arrow = async (p, q) => {
  switch (p) { case 1: return 2 }
}
let z = x => x + 1, w = 3
var o = { if: 1, class: 2, fn: function () { return 1 } };
"""
RUST = """use std::{fs, io};
/* outer /* { nested */ } */
#[derive(Debug)]
pub(crate) struct S<'a, T: Into<String> = u8> where T: Clone {
    a: &'a str,
}
struct U(i32);
pub trait Shape: Sized + Clone {
    fn area(&self) -> f64;
    fn name(&self) -> String { String::from("}") }
}
impl<'a, T: Into<String>> Shape for S<'a, T> {
    pub async fn go<F>(&mut self, f: F, n: Vec<(i32, u8)>) -> Result<Vec<i32>, Error> where F: Fn(i32) -> i32 {
        let c = '{';
        let s = r#"raw " } "#;
        if a < b && c > d { x() } else if let Some(y) = z { w() } else { match q { A => { 1 }, _ => 2 } }
        for i in 0..3 { while true { loop { break; } } }
        let g: for<'b> fn(&'b str) -> u8 = h;
    }
}
mod inner { pub fn f() {} }
macro_rules! sq { ($x:expr) => { $x * $x }; }
"""
GO = """package main
import (
	"fmt"
	"os"
)
type T struct {
	a int
}
func (t *T) M(x int) int {
	if y := f(x); y > 0 {
		return y
	}
	for _, v := range []int{1, 2} {
		fmt.Println(v, `}{`)
	}
	return 0
}
var q = 3
func main() {
	switch x := 1; x { case 1: }
}
"""
JAVA = '''package a.b;
import java.util.*;
/** doc { */
@Deprecated
public abstract class C<T> extends D implements E {
    private int x = f(1);
    public C(int a) { this.x = a; }
    @Override
    public <U> List<U> m(final int a, String b) throws IOException {
        if (a > 1) return null; else { b(); }
        for (int i = 0; i < 3; i++) { while (true) { } }
        try { x(); } catch (Exception e) { }
        String s = """
          } " {
          """;
    }
    abstract void n();
    interface I { void q(); }
}
'''
C = """#include <stdio.h>
#define X(a) { a
struct P { int x; };
typedef struct P P;
static int f(int a, char *b) {
    if (a) { return '}'; }
    for (;;) while (1) g();
    do { } while (0);
    switch (a) { case 1: break; }
    return 0;
}
int main(void) { struct P p; return f(1, "}"); }
"""
#: parent, kind, name, first and last line of every node, as a grammar gives them.
TREES = {
    "javascript": (SCRIPT, [
        (None, "import_statement", "./a", 1, 1), (None, "class_declaration", "K", 3, 8), (1, "method_definition", "m", 4, 6), (1, "method_definition", "v", 7, 7), (None, "export_statement", None, 9, 20), (4, "function_declaration", "f", 9, 20), (5, "if_statement", None, 10, 16), (6, "if_statement", None, 12, 16),
        (5, "for_statement", None, 17, 17), (8, "lexical_declaration", "i", 17, 17), (8, "if_statement", None, 17, 17), (5, "do_statement", None, 18, 18), (5, "try_statement", None, 19, 19), (12, "catch_clause", None, 19, 19), (None, "lexical_declaration", "arrow", 21, 23), (14, "arrow_function", None, 21, 23),
        (15, "switch_statement", None, 22, 22), (None, "lexical_declaration", "z", 24, 24), (17, "arrow_function", None, 24, 24), (None, "variable_declaration", "o", 25, 25), (19, "function_expression", None, 25, 25),
    ]),
    "rust": (RUST, [
        (None, "use_declaration", "std::{fs,io}", 1, 1), (None, "struct_item", "S", 4, 6), (None, "struct_item", "U", 7, 7), (None, "trait_item", "Shape", 8, 11), (3, "function_item", "area", 9, 9), (3, "function_item", "name", 10, 10), (None, "impl_item", "S", 12, 20), (6, "function_item", "go", 13, 19),
        (7, "let_declaration", "c", 14, 14), (7, "let_declaration", "s", 15, 15), (7, "if_expression", None, 16, 16), (10, "if_expression", None, 16, 16), (11, "match_expression", None, 16, 16), (7, "for_expression", None, 17, 17), (13, "while_expression", None, 17, 17), (14, "loop_expression", None, 17, 17),
        (7, "let_declaration", "g", 18, 18), (None, "mod_item", "inner", 21, 21), (17, "function_item", "f", 21, 21), (None, "macro_definition", "sq", 22, 22),
    ]),
    "go": (GO, [
        (None, "package_clause", "main", 1, 1), (None, "import_declaration", "fmt,os", 2, 5), (None, "type_declaration", "T", 6, 8), (None, "method_declaration", "M", 9, 17), (3, "if_statement", None, 10, 12), (3, "for_statement", None, 13, 15), (None, "var_declaration", None, 18, 18), (None, "function_declaration", "main", 19, 21),
        (7, "switch_statement", None, 20, 20),
    ]),
    "java": (JAVA, [
        (None, "package_declaration", None, 1, 1), (None, "import_declaration", "java.util.*", 2, 2), (None, "class_declaration", "C", 4, 19), (2, "constructor_declaration", "C", 7, 7), (2, "method_declaration", "m", 8, 16), (4, "if_statement", None, 10, 10), (4, "for_statement", None, 11, 11), (6, "while_statement", None, 11, 11),
        (4, "try_statement", None, 12, 12), (8, "catch_clause", None, 12, 12), (2, "method_declaration", "n", 17, 17), (2, "interface_declaration", "I", 18, 18), (11, "method_declaration", "q", 18, 18),
    ]),
    "c": (C, [
        (None, "preproc_include", "<stdio.h>", 1, 1), (None, "struct_specifier", "P", 3, 3), (None, "type_definition", None, 4, 4), (None, "function_definition", "f", 5, 11), (3, "if_statement", None, 6, 6), (3, "for_statement", None, 7, 7), (5, "while_statement", None, 7, 7), (3, "do_statement", None, 8, 8),
        (3, "switch_statement", None, 9, 9), (None, "function_definition", "main", 12, 12),
    ]),
}


@pytest.mark.parametrize("language", TREES)
def test_trees_made_by_hand(language):
    text, wanted = TREES[language]
    made = brace_source.rows_of(text, language)
    assert [(r["parent"], r["kind"], r["name"], r["line"], r["end_line"]) for r in made] == wanted
    assert [r["position"] for r in made] == list(range(len(made)))
    assert all(r["level"] == (0 if r["parent"] is None else made[r["parent"]]["level"] + 1) for r in made)


def test_signatures():
    rows = {r["name"]: r for r in brace_source.rows_of(RUST, "rust")}
    go = rows["go"]
    assert go["modifiers"] == ["pub", "async"] and go["generics"] == ["F"] and go["returns"] == "Result<Vec<i32>,Error>"
    assert [(p["name"], p["type"]) for p in go["parameters"]] == [("&mut self", None), ("f", "F"), ("n", "Vec<(i32,u8)>")]
    assert rows["S"]["generics"] == ["'a", "T : Into < String >"] and rows["Shape"]["modifiers"] == ["pub"]
    m = next(r for r in brace_source.rows_of(JAVA, "java") if r["name"] == "m")
    assert m["generics"] == ["U"] and m["returns"] == "List<U>" and [(p["name"], p["type"]) for p in m["parameters"]] == [("a", "int"), ("b", "String")]
    typed = brace_source.rows_of("function f(a: number, b?: Map<string, number[]>, ...c): void { }", "typescript")[0]
    assert [(p["name"], p["type"]) for p in typed["parameters"]] == [("a", "number"), ("b?", "Map<string,number[]>"), ("...c", None)] and typed["returns"] == "void"


@pytest.mark.parametrize("language", brace_source.KINDS)
def test_deep_and_broken_files(language):
    n = 100_000
    assert brace_source.rows_of("{([" * n, language) == [] and brace_source.rows_of("})]" * n, language) == []
    deep = brace_source.rows_of("if (a) {\n" * n + "}\n" * n, language)
    assert len(deep) == n and deep[-1]["level"] == n - 1 and deep[0]["end_line"] == 2 * n
    for broken in ("", "/*" * n, '"' * (n + 1), "`${" * n, "'", "/* { ", "if", "function", "class {", "fn f(", "impl", "a => ", "struct S {", "}" * 9 + " if (a) { }", "#[", "\\", "\0", "import", "else", "r#\"never closed"):
        brace_source.rows_of(broken, language)


def test_nodes_of_odd_rows(spark):
    files = spark.createDataFrame([("a", "go", None), ("b", None, "if"), ("c", "cobol", "if"), (None, "c", "int f() { }"), ("e", "java", "")], "path string, language string, content string")
    assert [(r["path"], r["name"], r["level"]) for r in brace_source.nodes(files).collect()] == [(None, "f", 0)]


OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.BitOr: "|", ast.BitAnd: "&", ast.BitXor: "^", ast.LShift: "<<", ast.RShift: ">>", ast.MatMult: "@", ast.And: "and", ast.Or: "or", ast.Not: "not", ast.USub: "-", ast.UAdd: "+", ast.Invert: "~",
             ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.In: "in", ast.NotIn: "not in", ast.Is: "is", ast.IsNot: "is not"}


def by_python(n):
    """The tree of Python's parser, in the form of expressions.tree without literals' values."""
    one = lambda kind, value, children: [(kind, value, len(children)), *(x for c in children for x in by_python(c))]
    match n:
        case ast.BinOp():
            return one("binary", OPERATORS[type(n.op)], [n.left, n.right])
        case ast.BoolOp():
            return one("boolean", OPERATORS[type(n.op)], n.values)
        case ast.Compare():
            return one("comparison", " ".join(OPERATORS[type(o)] for o in n.ops), [n.left, *n.comparators])
        case ast.UnaryOp():
            return one("unary", OPERATORS[type(n.op)], [n.operand])
        case ast.Call():
            return one("call", None, [n.func, *sorted([*n.args, *n.keywords], key=lambda x: (x.lineno, x.col_offset))])
        case ast.keyword():
            return one("keyword", n.arg, [n.value]) if n.arg else one("starred", "**", [n.value])
        case ast.Starred():
            return one("starred", "*", [n.value])
        case ast.Attribute():
            return one("attribute", n.attr, [n.value])
        case ast.Subscript():
            return one("subscript", None, [n.value, n.slice])
        case ast.Slice():
            return one("slice", None, [x for x in (n.lower, n.upper, n.step) if x])
        case ast.IfExp():
            return one("conditional", None, [n.body, n.test, n.orelse])
        case ast.Tuple() | ast.List() | ast.Set():
            return one(type(n).__name__.lower(), None, n.elts)
        case ast.Dict():
            return one("dict", None, [x for kv in zip(n.keys, n.values) for x in kv])
        case ast.Name():
            return one("identifier", n.id, [])
    return one("literal", None, [])


def random_expression(r, depth):
    if depth <= 0:
        return r.choice(["a", "b", "x1", "3", "2.5e3", "'s'", "None", "True", "...", "0x1f"])
    g = lambda: random_expression(r, depth - 1 - r.randrange(2))
    return r.choice([
        lambda: f"{g()} {r.choice('+ - * / // % ** | & ^ << >> @'.split())} {g()}", lambda: f"{g()} {r.choice(['+', '-', '**', '*'])} {g()}", lambda: f"{g()} {r.choice(['and', 'or'])} {g()}", lambda: f"({g()} {r.choice(['<', '==', 'in', 'not in', 'is', 'is not'])} {g()} <= {g()})",
        lambda: f"-{g()}", lambda: f"not {g()}", lambda: f"(~{g()})", lambda: f"f({g()}, {g()}, n={g()}, *a, **b)", lambda: f"({g()}).attr.b", lambda: f"q[{g()}]", lambda: f"q[{g()}:{g()}]", lambda: f"q[:{g()}:2]", lambda: f"({g()} if {g()} else {g()} if {g()} else {g()})", lambda: f"[{g()}, {g()}]",
        lambda: f"({g()}, )", lambda: f"({g()})", lambda: f"{{{g()}: {g()}, {g()}: {g()}}}", lambda: "run()",
    ])()


def test_expressions_against_pythons_parser():
    r, n = random.Random(5), 0
    while n < 4_000:
        text = random_expression(r, r.randrange(1, 6))
        try:
            wanted = by_python(ast.parse(text, mode="eval").body)
        except SyntaxError:
            continue
        n += 1
        assert [(k, None if k == "literal" else v, c) for k, v, c in expressions.tree(text)] == wanted, text


def test_expressions_that_are_none():
    for text in ("", "  ", "a.", "(a", "a b", "f(x=", "lambda x: x", "[x for x in y]", "a if b", "x[]", "a = b", ")", "a)", "f(a b)", "a +", "not", "f(a:b)", "\\", "a ? b", "if"):
        assert expressions.tree(text) is None, text


def test_deep_expressions():
    assert expressions.tree("(" * 100_000 + "x" + ")" * 100_000) == [("identifier", "x", 0)]
    made = expressions.figures(expressions.tree("x + " * 50_000 + "y"))
    assert made["score"] == 1 + 5 * 50_000 and made["depth"] == 50_001 and made["variables"] == ["x", "y"]


def test_deep_python_files(spark):
    """A sum of 1,500 terms parses, but its tree is too deep for a walk that calls itself."""
    text = "def f():\n    return " + " + ".join(["g(x)"] * 1_500) + "\ny = " + "+".join("1" * 1_500) + "\n"
    files = spark.createDataFrame([("a", text), ("b", "def g(): pass"), ("c", "def broken(")], "path string, content string")
    rows = python_source.blocks(files).orderBy("path", "position").collect()
    assert [(r["path"], r["block_type"], r["name"]) for r in rows] == [("a", "Function", "f"), ("a", "Variable", "y"), ("b", "Function", "g")]
    assert rows[0]["raw_text"] == text.split("\ny")[0] and rows[0]["details"].count('"g"') == 1_500
    assert {r["path"]: r["lines"] for r in python_source.figures(files).collect()} == {"a": 4, "b": 1}
    assert python_source.nodes(files).where("type = 'call'").count() == 1_500
