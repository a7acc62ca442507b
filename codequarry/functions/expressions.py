"""Expression trees of Python-like expressions, by precedence with a stack in place of recursion.

A tree is its nodes in pre-order: kind, value (operator, name or literal) and number of children, so that trees
of any depth are flat arrays. What is not an expression (or holds a lambda, a comprehension or an assignment) gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s+|#[^\n]*|(?P<string>(?i:rb|br|fr|rf|[rbfu])?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"))|(?P<number>0[xXoObB][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?)|(?P<name>[^\W\d]\w*)|(?P<op>\*\*|//|<<|>>|<=|>=|==|!=|\.\.\.|[-+*/%@&|^~<>().,:=\[\]{}])", re.S)
#: Of binary operators, by how tightly they bind. All bind to the left but **.
PRECEDENCE = {"or": 3, "and": 4, "in": 6, "not in": 6, "is": 6, "is not": 6, "<": 6, ">": 6, "<=": 6, ">=": 6, "==": 6, "!=": 6, "|": 7, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "//": 12, "%": 12, "@": 12, "**": 14}
NOT, SIGN, CONDITION, ELEMENT = 5, 13, 2, 1
PAIRS = {")": "(", "]": "[", "}": "{"}
OPERATORS = ("binary", "comparison", "boolean", "unary")
LITERALS = ("True", "False", "None")
#: Words that no operand is.
RESERVED = {"lambda", "for", "while", "await", "yield", "async", "def", "class", "return", "import", "if", "else", "and", "or", "in", "is", "del", "pass", "assert", "raise", "with", "as", "try", "from", "global", "nonlocal", "break", "continue", "elif", "except", "finally"}


def lexed(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(text[at : at + 20])
        at = m.end()
        if m.lastgroup:
            kind, word = m.lastgroup, m[0]
            if out and kind == "name" and (out[-1][1], word) in (("not", "in"), ("is", "not")):
                out[-1] = "name", f"{out[-1][1]} {word}"
            elif not (out and kind == "string" == out[-1][0]):  # neighbouring strings are one
                out.append((kind, word))
    return out


class Parser:
    """Operands are places in nodes (kind, value, children); the stack holds operators (what, precedence, value) and open brackets
    (what, 0, parts, bracket, whether a comma was seen, and what is called or subscripted)."""

    def __init__(self, text: str):
        self.nodes: list[tuple[str, str | None, list[int]]] = []
        self.operands: list[int] = []
        self.stack: list[list] = []
        self.tokens = lexed(text)
        self.next = self._operand  # what takes the next token
        for kind, word in self.tokens:
            self.next(kind, word)
        if self.next == self._operator:
            self._reduce(0)
        if self.stack and self.stack[0][0] == "tuple" and len(self.stack) == 1:
            self._node("tuple", None, self.stack.pop()[2] + self.operands[:1])
            self.operands = self.operands[-1:]
        if self.stack or len(self.operands) != 1 or self.next == self._attribute:
            raise ValueError("ends early")
        self.root = self.operands[0]

    def _node(self, kind: str, value: str | None, children: list[int]) -> None:
        self.nodes.append((kind, value, children))
        self.operands.append(len(self.nodes) - 1)

    def _reduce(self, least: int, right: bool = False) -> None:
        """Apply the operators on top that bind tighter than `least`, or as tightly unless the next one binds to the right."""
        while self.stack and self.stack[-1][1] and (self.stack[-1][1] > least or self.stack[-1][1] == least and not right):
            what, _, value = self.stack.pop()
            if what == "if":
                raise ValueError("no else")
            n = {"unary": 1, "element": 1, "binary": 2, "conditional": 3}.get(what) or len(value) + 1
            children = self.operands[-n:]
            del self.operands[-n:]
            if what == "element":
                self._node(value[0], value[1], children)
            elif what in ("comparison", "boolean"):
                self._node(what, " ".join(value) if what == "comparison" else value[0], children)
            else:
                self._node(what, value, children)

    def _operand(self, kind: str, word: str) -> None:
        top = self.stack[-1] if self.stack else None
        if kind in ("number", "string") or word in LITERALS or word == "...":
            self._node("literal", word, [])
        elif word == "not":
            self.stack.append(["unary", NOT, "not"])
            return
        elif kind == "name" and word not in RESERVED and " " not in word:
            self._node("identifier", word, [])
        elif word in ("-", "+", "~"):
            self.stack.append(["unary", SIGN, word])
            return
        elif word in ("*", "**") and top and not top[1]:
            self.stack.append(["element", ELEMENT, ("starred", word)])
            return
        elif word in "([{" and kind == "op":
            self.stack.append([{"(": "group", "[": "list", "{": "set"}[word], 0, [], word, False])
            return
        elif word == ":" and top and top[0] == "subscript":
            self._colon(top)
            return
        elif word in PAIRS and top and not top[1] and top[3:4] == [PAIRS[word]]:
            self._close(top, None)
        else:
            raise ValueError(word)
        self.next = self._operator

    def _operator(self, kind: str, word: str) -> None:
        if word in PRECEDENCE and kind != "string":
            p = PRECEDENCE[word]
            self._reduce(p + (p in (4, 3, 6)), right=word == "**" or p in (3, 4, 6))
            if p in (3, 4, 6):
                while self.stack and self.stack[-1][1] > p:
                    self._reduce(p, right=True)
                if self.stack and self.stack[-1][1] == p:
                    self.stack[-1][2].append(word)
                else:
                    self.stack.append(["comparison" if p == 6 else "boolean", p, [word]])
            else:
                self.stack.append(["binary", p, word])
        elif word == "if":
            self._reduce(CONDITION, right=True)
            self.stack.append(["if", CONDITION, None])
        elif word == "else":
            self._reduce(CONDITION, right=True)
            if not self.stack or self.stack[-1][0] != "if":
                raise ValueError("else")
            self.stack[-1][0] = "conditional"
        elif word == ".":
            self.next = self._attribute
            return
        elif word in ("(", "["):
            self.stack.append(["call" if word == "(" else "subscript", 0, [], word, False, self.operands.pop()])
        elif word in PAIRS:
            self._reduce(0, right=True)
            top = self.stack[-1] if self.stack else None
            if not top or top[3:4] != [PAIRS[word]]:
                raise ValueError(word)
            self._close(top, self.operands.pop())
            return
        elif word == ",":
            self._reduce(0, right=True)
            if not self.stack:
                self.stack.append(["tuple", 0, [], "", True])
            self._add(self.stack[-1])
            self.stack[-1][4] = True
        elif word == ":":
            self._reduce(0, right=True)
            top = self.stack[-1] if self.stack else None
            if not top or top[0] not in ("set", "dict", "subscript"):
                raise ValueError(word)
            if top[0] == "subscript":
                self._add(top)
                self._colon(top)
            else:
                top[0] = "dict"
                self._add(top)
        elif word == "=" and self.stack and self.nodes[self.operands[-1]][0] == "identifier" and self.stack[-1][0] == "call":
            self.stack.append(["element", ELEMENT, ("keyword", self.nodes[self.operands.pop()][1])])
        else:
            raise ValueError(word)
        self.next = self._operand

    def _attribute(self, kind: str, word: str) -> None:
        if kind != "name":
            raise ValueError(word)
        self._node("attribute", word, [self.operands.pop()])
        self.next = self._operator

    def _add(self, top: list) -> None:
        top[2].append(self.operands.pop())

    def _colon(self, top: list) -> None:
        if len(top) < 7:
            top.append("slice")

    def _close(self, top: list, last: int | None) -> None:
        self.stack.pop()
        what, parts, comma = top[0], top[2] + ([] if last is None else [last]), top[4]
        if what == "group":
            if len(parts) == 1 and not comma:
                self.operands.append(parts[0])
            else:
                self._node("tuple", None, parts)
        elif what == "call":
            self._node("call", None, [top[5], *parts])
        elif what == "subscript":
            if len(top) == 7:
                self._node("slice", None, parts)
                parts = [self.operands.pop()]
            elif len(parts) != 1 or comma:
                if not parts:
                    raise ValueError("nothing in brackets")
                self._node("tuple", None, parts)
                parts = [self.operands.pop()]
            self._node("subscript", None, [top[5], *parts])
        else:
            self._node("dict" if what == "set" and not parts else what, None, parts)
        self.next = self._operator


def tree(text: str) -> list[tuple[str, str | None, int]] | None:
    """(kind, value, number of children) in pre-order, or None."""
    try:
        own = Parser(text)
    except (ValueError, IndexError):
        return None
    out, work = [], [own.root]
    while work:
        kind, value, children = own.nodes[work.pop()]
        out.append((kind, value, len(children)))
        work += children[::-1]
    return out


def figures(nodes: list[tuple[str, str | None, int]]) -> dict:
    """depth, score, and the names of calls, attributes and variables in order.

    A node's score is 1, 1 for each operand and the operands' own scores, 2 for each call and 1 for each attribute (a chain of them is one) at or
    below it, and 2 for and, or and **, 1 for any other operator. What is called and its arguments are no operands; a called name is no variable."""
    depth, after, calls, attributes, variables = 0, "", [], [], []
    below: list[tuple[int, int, int]] = []  # of finished subtrees: score, calls, attributes
    for kind, value, n in reversed(nodes):
        children = below[len(below) - n :]
        del below[len(below) - n :]
        n_calls = sum(x[1] for x in children) + (kind == "call")
        n_attributes = sum(x[2] for x in children) + (kind == "attribute" != after)
        operands = [] if kind in ("call", "attribute") else children
        weight = (2 if value in ("and", "or", "**") else 1) if kind in OPERATORS else 0
        below.append((1 + len(operands) + sum(x[0] for x in operands) + 2 * n_calls + n_attributes + weight, n_calls, n_attributes))
        after = kind
    open_: list[int] = []
    for k, (kind, value, n) in enumerate(nodes):
        open_.append(n)
        depth = max(depth, len(open_))
        if kind == "call":
            calls.append(nodes[k + 1][1] if nodes[k + 1][0] in ("identifier", "attribute") else None)
        elif kind == "attribute":
            attributes.append(value)
        elif kind == "identifier" and (not k or nodes[k - 1][0] != "call"):
            variables.append(value)
        while open_ and not open_[-1]:
            open_.pop()
            if open_:
                open_[-1] -= 1
    return {"depth": depth, "score": below[0][0], "calls": calls, "attributes": attributes, "variables": list(dict.fromkeys(variables))}


ROW = "kind string, operator string, n_nodes long, depth long, score long, calls array<string>, attributes array<string>, variables array<string>, tree array<struct<kind:string,value:string,children:int>>"


def trees(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys and ROW of every row whose text is an expression."""
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + ", " + ROW
    names = [*keys, "kind", "operator", "n_nodes", "depth", "score", "calls", "attributes", "variables", "tree"]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, x in zip(batch[list(keys)].to_dict("records"), batch[text], strict=True):
                if found := tree(x):
                    shown = [{"kind": k, "value": v, "children": n} for k, v, n in found]
                    out.append(own | {"kind": found[0][0], "operator": found[0][1] if found[0][0] in OPERATORS else None, "n_nodes": len(found), "tree": shown} | figures(found))
            yield pd.DataFrame(out, columns=names)

    return rows.select(*keys, F.coalesce(text, F.lit("")).alias(text)).mapInPandas(made, schema)
