"""Syntax nodes of languages with braces (JavaScript, TypeScript, Rust, Go, Java, C), file by file.

A lexer driven by a table of each language leaves out comments (nested ones too) and the insides of strings,
template strings and regular expressions. The parser walks the tokens once, with a stack of its own for brackets
and open nodes, so that depth is bounded by memory alone. It finds the kinds in KINDS, declarations and
branches, and no others; a file with brackets that don't match gives what can be told. Rows go on as a
DataFrame, from which figures by file are plain groupings.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a node of a keyword ends: with its block or, without one, its statement (BODY); with its statement (LINE); with the declaration in it (WRAP).
BODY, LINE, WRAP = "body", "line", "wrap"
_BRANCHES = {"if": ("if_statement", BODY), "for": ("for_statement", BODY), "while": ("while_statement", BODY), "switch": ("switch_statement", BODY)}
_SCRIPT = _BRANCHES | {
    "function": ("function_declaration", BODY), "class": ("class_declaration", BODY), "try": ("try_statement", BODY), "catch": ("catch_clause", BODY), "do": ("do_statement", BODY), "import": ("import_statement", LINE), "export": ("export_statement", WRAP),
    "var": ("variable_declaration", LINE), "let": ("lexical_declaration", LINE), "const": ("lexical_declaration", LINE),
}
#: By language: keyword to kind of node, by the names that grammars give them.
KINDS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT | {"interface": ("interface_declaration", BODY), "type": ("type_alias_declaration", LINE), "enum": ("enum_declaration", BODY), "namespace": ("internal_module", BODY)},
    "rust": {
        "fn": ("function_item", BODY), "impl": ("impl_item", BODY), "struct": ("struct_item", BODY), "enum": ("enum_item", BODY), "trait": ("trait_item", BODY), "mod": ("mod_item", BODY), "macro_rules": ("macro_definition", BODY), "let": ("let_declaration", LINE), "use": ("use_declaration", LINE),
        "if": ("if_expression", BODY), "while": ("while_expression", BODY), "for": ("for_expression", BODY), "loop": ("loop_expression", BODY), "match": ("match_expression", BODY),
    },
    "go": {"func": ("function_declaration", BODY), "type": ("type_declaration", LINE), "var": ("var_declaration", LINE), "const": ("const_declaration", LINE), "import": ("import_declaration", LINE), "package": ("package_clause", LINE), "if": ("if_statement", BODY), "for": ("for_statement", BODY), "switch": ("switch_statement", BODY)},
    "java": _BRANCHES | {"class": ("class_declaration", BODY), "interface": ("interface_declaration", BODY), "enum": ("enum_declaration", BODY), "try": ("try_statement", BODY), "catch": ("catch_clause", BODY), "do": ("do_statement", BODY), "import": ("import_declaration", LINE), "package": ("package_declaration", LINE)},
    "c": _BRANCHES | {"struct": ("struct_specifier", BODY), "enum": ("enum_specifier", BODY), "typedef": ("type_definition", LINE), "do": ("do_statement", BODY)},
}
#: Universal types of kinds; others keep their kind.
TYPES = {
    "function_declaration": "function", "function_expression": "function", "arrow_function": "function", "function_item": "function", "function_definition": "function", "method_definition": "method", "method_declaration": "method", "class_declaration": "class", "interface_declaration": "interface",
    "type_alias_declaration": "type", "type_declaration": "type", "variable_declaration": "variable", "var_declaration": "variable", "let_declaration": "variable", "const_declaration": "constant", "import_statement": "import", "import_declaration": "import", "use_declaration": "import", "export_statement": "export",
    "impl_item": "implementation", "struct_item": "struct", "struct_specifier": "struct", "enum_item": "enum", "enum_specifier": "enum", "trait_item": "trait", "mod_item": "module", "package_clause": "package", "package_declaration": "package", "preproc_include": "include",
}
#: Kinds that each add one to a file's complexity.
BRANCHES = ("if_statement", "while_statement", "for_statement", "switch_statement", "catch_clause", "if_expression", "while_expression", "for_expression", "match_expression")
#: Declarations whose modifiers before the keyword belong to them.
MODIFIED = {"function_declaration", "function_item", "impl_item", "struct_item", "enum_item", "trait_item", "mod_item", "use_declaration", "class_declaration", "interface_declaration", "enum_declaration"}
MODIFIERS = {"pub", "async", "const", "unsafe", "extern", "default", "abstract", "public", "private", "protected", "static", "final", "sealed", "declare"}
#: After these a statement goes on; after these words a slash begins a regular expression.
OPEN_END = set("+-*/%=<>&|^!?:,.([{") | {"=>", "->", "::"}
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "else", "do"}
CLOSERS = {")": "(", "]": "[", "}": "{"}
COMMENT, SPACE, STRING = "comment", "space", "string"
_PLAIN = {'"': r'"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)', "'": r"'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)", "`": r"`[^`]*+(?:`|\Z)", '"""': r'"""(?:[^\\]|\\.)*?(?:"""|\Z)'}
#: By language: strings as patterns, tried in order.
STRINGS = {
    "javascript": (_PLAIN['"'], _PLAIN["'"]), "typescript": (_PLAIN['"'], _PLAIN["'"]), "go": (_PLAIN['"'], _PLAIN["'"], _PLAIN["`"]), "java": (_PLAIN['"""'], _PLAIN['"'], _PLAIN["'"]), "c": (_PLAIN['"'], _PLAIN["'"]),
    "rust": (r'[bc]?r(?P<hashes>#*)".*?(?:"(?P=hashes)|\Z)', r'[bc]?"(?:[^"\\]|\\.)*+(?:"|\Z)', r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\])'"),
}
WORD = re.compile(r"[A-Za-z_$#][\w$]*")


@lru_cache(maxsize=None)
def lexer(language: str) -> re.Pattern:
    include = r"(?P<include>^[ \t]*\#[^\n]*(?:\\\n[^\n]*)*)|" if language == "c" else ""
    life = r"(?P<life>'[A-Za-z_]\w*)|" if language == "rust" else ""
    strings = "|".join(STRINGS[language])
    return re.compile(rf"{include}(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<string>{strings})|{life}(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$\u0080-\U0010ffff#@][\w$]*)|(?P<op>=>|->|::|.)", re.S | re.M)


def tokens(text: str, language: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) without space and comments; kinds: word, number, string, op, include."""
    find, at, last, holes, depth = lexer(language).match, 0, ("op", ";"), [], 0
    script, nested = language in ("javascript", "typescript"), language == "rust"
    marks = re.compile(r"/\*|\*/") if nested else re.compile(r"\*/")
    while at < len(text):
        c = text[at]
        if script and (c == "`" or (c == "}" and holes and holes[-1] == depth)):  # template strings go on behind their holes
            if c == "}":
                holes.pop()
                yield "op", "}", at, at + 1
            end = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S).match(text, at + 1).end()
            yield "string", text[at:end], at, end
            last = "string", ""
            if text.startswith("${", end):
                holes.append(depth)
                yield "op", "{", end + 1, end + 2
                end, last = end + 2, ("op", "{")
            else:
                end += 1
            at = end
            continue
        if script and c == "/" and text[at + 1 : at + 2] not in ("/", "*") and (last[0] == "op" and last[1] not in (")", "]", "}") or last[1] in BEFORE_REGEX):
            m = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*").match(text, at)
            if m:
                yield "string", m[0], at, m.end()
                at, last = m.end(), ("string", "")
                continue
        m = find(text, at)
        kind, at = "string" if m["string"] is not None else m.lastgroup, m.end()
        if kind == "block":
            open_, inner = 1, m.end()
            while open_ and (found := marks.search(text, inner)):
                open_, inner = open_ + (1 if found[0] == "/*" else -1), found.end()
            at = len(text) if open_ else inner
        elif kind not in ("space", "line"):
            if kind == "op":
                depth += (m[0] == "{") - (m[0] == "}")
            kind = "word" if kind == "life" else kind
            last = kind, m[0]
            yield kind, m[0], m.start(), at


class Nodes:
    """The nodes of one file, in order of their starts: kind, name, parent (a place or None), level, first and last token."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.kinds = text, language, KINDS[language]
        self.tokens = list(tokens(text, language))
        self.rows: list[dict] = []
        self.open: list[int] = []  # nodes
        self.brackets: list[tuple[str, int, int | None, int]] = []  # opener, token, the node whose body it is, nodes that were open
        self.group = 0  # the token that opened the brackets closed last
        self.starts = [0]  # by depth of brackets, the token at which the statement begins
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self._walk()

    def token(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) and self.tokens[i][0] != "string" else ""

    def _begin(self, kind: str, role: str, first: int, name: str | None, keyword: int) -> None:
        parent = self.open[-1] if self.open else None
        self.rows.append({"kind": kind, "role": role, "name": name, "parent": parent, "level": self.rows[parent]["level"] + 1 if parent is not None else 0, "first": first, "last": first, "depth": len(self.brackets), "body": None, "keyword": keyword, "tail": False})
        self.open.append(len(self.rows) - 1)

    def _end(self, i: int) -> None:
        """The innermost node ends with token i; with it those that wrap it or have waited for it as their last part."""
        while self.open:
            node = self.rows[self.open.pop()]
            node["last"] = max(node["last"], i)
            above = self.rows[self.open[-1]] if self.open else None
            if above is None or above["depth"] != len(self.brackets):
                return
            waits = above["role"] == BODY and (above["body"] is None or above["tail"]) and node["role"] == BODY
            statement = waits and above["body"] is None and self.language not in ("rust", "go") and above["kind"] in (*BRANCHES, "do_statement")  # without braces
            otherwise = waits and above["tail"] and above["kind"].startswith("if_") and self.token(node["first"] - 1) == "else"
            caught = waits and above["tail"] and node["kind"] == "catch_clause" and self.token(i + 1) not in ("catch", "finally")
            if not (above["role"] == WRAP or statement or otherwise or caught):
                return

    def _name(self, i: int) -> str | None:
        """The first name behind a keyword."""
        for j in range(i + 1, min(i + 6, len(self.tokens))):
            kind, text = self.tokens[j][:2]
            if kind == "word" and text not in ("mut", "ref"):
                return text
            if text not in ("*", "!", "<") or kind == "string":
                return None
        return None

    def _keyword(self, i: int, word: str) -> None:
        before, after = self.token(i - 1), self.token(i + 1)
        if before in (".", "::", "@") or after in (":", ",", "=>") and word not in ("default",):
            return
        kind, role = self.kinds[word]
        node = self.rows[self.open[-1]] if self.open else None
        waiting = node is not None and node["body"] is None and node["depth"] == len(self.brackets)
        if word == "while" and node is not None and node["kind"] == "do_statement" and node["tail"]:
            return
        if self.language == "rust" and (word == "for" and (after == "<" or waiting and node["kind"] == "impl_item") or word == "fn" and after == "(" or word == "impl" and waiting and node["kind"] in ("function_item", "let_declaration") or word == "macro_rules" and after != "!" or word == "let" and before in ("if", "while")):
            return
        if word == "import" and after in ("(", ".") and self.language != "go" or word == "type" and self.language == "typescript" and self.tokens[i + 1 : i + 2] and self.tokens[i + 1][0] != "word":
            return
        if self.language == "c" and word in ("struct", "enum") and "{" not in (after, self.token(i + 2)):
            return  # a use of the type
        first = i
        name = self._name(i) if kind in MODIFIED or kind in ("macro_definition", "type_alias_declaration", "struct_specifier", "enum_specifier", "internal_module", "let_declaration", "variable_declaration", "lexical_declaration") else None
        if kind in MODIFIED:
            while first > self.starts[-1] and (self.token(first - 1) in MODIFIERS or self.language == "java" and self.token(first - 1) not in ("{", "}", ";", "")):
                first -= 1
            if self.language == "rust" and self.token(first - 1) == ")":  # pub(crate)
                opener = next((j for j in range(first - 1, max(first - 6, -1), -1) if self.token(j) == "pub"), first)
                first = opener
        if word in ("function", "func"):
            if word == "func" and after == "(":
                kind = "method_declaration" if not self.brackets else "func_literal"
                closer = next((j for j in range(i, min(i + 40, len(self.tokens))) if self.token(j) == ")"), i)
                name = self._name(closer) if not self.brackets else None
            elif word == "function" and self.token(first - 1) not in ("", ";", "}", "{", "export", "default") and self.tokens[first - 1][0] != "string":
                kind = "function_expression"
        if kind == "impl_item":
            head = [self.token(j) for j in range(i + 1, min(len(self.tokens), i + 400))]
            head = head[: head.index("{")] if "{" in head else head
            name = implemented(head)[1]
        if kind in ("use_declaration", "import_declaration", "import_statement", "package_clause", "package_declaration", "type_declaration"):
            name = self._name(i) if kind in ("type_declaration", "package_clause") else None
        self._begin(kind, role, first, name, i)

    def _method(self, i: int, opener: int) -> None:
        """A list of parameters in brackets ends at token i: is it that of a method, or of a function in C?"""
        holder = next((b for b in reversed(self.brackets) if b[0] == "{"), None)
        named, after = self.token(opener - 1), self.token(i + 1)
        in_class = holder is not None and holder[2] is not None and self.rows[holder[2]]["kind"] in ("class_declaration", "interface_declaration", "enum_declaration") and holder is self.brackets[-1]
        if not named or self.tokens[opener - 1][0] != "word" or named in self.kinds or named in ("return", "else", "new", "super", "this"):
            return
        start = self.starts[-1]
        said = [self.token(j) for j in range(start, opener)]
        if self.language in ("javascript", "typescript") and in_class and after in ("{", ":") and "=" not in said:
            self._begin("method_definition", BODY, start, named, opener - 1)
        elif self.language == "java" and in_class and after in ("{", "throws", ";") and "=" not in said and self.token(opener - 2) != "@" and not named.startswith("@"):
            own = self.rows[holder[2]]["name"]
            self._begin("constructor_declaration" if named == own else "method_declaration", BODY, start, named, opener - 1)
        elif self.language == "c" and not self.brackets and after == "{" and "=" not in said:
            self._begin("function_definition", BODY, start, named, opener - 1)

    def _walk(self) -> None:
        newline_ends = self.language in ("javascript", "typescript", "go")
        for i, (kind, text, start, _) in enumerate(self.tokens):
            node = self.rows[self.open[-1]] if self.open else None
            if newline_ends and node and node["role"] in (LINE, "arrow") and node["depth"] == len(self.brackets) and i > node["keyword"] + 1 and self.token(i - 1) not in OPEN_END and not (kind == "op" and text not in "{}()[]`") and "\n" in self.text[self.tokens[i - 1][3] : start] and text not in ("(", "["):
                self._end(i - 1)
                if node["role"] == LINE:
                    self.starts[-1] = i
            if kind == "include":
                if text.lstrip().startswith("#include"):
                    self._begin("preproc_include", LINE, i, text.split("include", 1)[1].strip(), i)
                    self._end(i)
                self.starts[-1] = i + 1
            elif kind == "word" and text in self.kinds:
                self._keyword(i, text)
            elif kind == "op" and text in "([{":
                owner = None
                if text == "{" and self.open and node["depth"] == len(self.brackets) and node["role"] in (BODY, "arrow") and (node["body"] is None or node["tail"]) and not (self.language == "go" and self.token(i - 2) == "]"):
                    owner, node["body"], node["tail"] = self.open[-1], i, False
                self.brackets.append((text, i, owner, len(self.open)))
                self.starts.append(i + 1)
            elif kind == "op" and text in CLOSERS:
                self._close(i, CLOSERS[text])
            elif kind == "op" and text == "=>" and self.language in ("javascript", "typescript"):
                first = self.group if self.token(i - 1) == ")" else i - 1
                first -= self.token(first - 1) == "async"
                self._begin("arrow_function", "arrow", first, None, i)
            elif kind == "op" and text in ";,":
                while self.open and (node := self.rows[self.open[-1]])["depth"] == len(self.brackets) and (node["role"] == "arrow" or text == ";" and not (self.language == "go" and node["role"] == BODY)):
                    self._end(i if text == ";" and node["role"] != "arrow" else i - 1)
                if text == ";":
                    self.starts[-1] = i + 1
        while self.open:
            node = self.rows[self.open.pop()]
            node["last"] = max(node["last"], len(self.tokens) - 1)

    def _close(self, i: int, opener: str) -> None:
        if not any(b[0] == opener for b in self.brackets[-64:]):  # nothing near that it closes
            return
        while self.brackets:
            kind, at, owner, n_open = self.brackets.pop()
            self.starts.pop()
            while len(self.open) > n_open:
                node = self.rows[self.open.pop()]
                node["last"] = max(node["last"], i - 1)
            if kind == opener:
                break
        after = self.token(i + 1)
        if opener == "(":
            self.group = at
            self._method(i, at)
        if opener == "{":
            if owner is not None and self.open and self.open[-1] == owner:
                node = self.rows[owner]
                if after == "else" and node["kind"].startswith("if_") or after == "while" and node["kind"] == "do_statement" or after in ("catch", "finally") and node["kind"] == "try_statement":
                    node["tail"], node["last"] = True, i
                else:
                    self._end(i)
            if after not in ("else", "catch", "finally", ")", ",", ";", ".") and not (self.open and self.rows[self.open[-1]]["role"] == LINE and self.rows[self.open[-1]]["depth"] == len(self.brackets)):
                self.starts[-1] = i + 1

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)


def implemented(head: list[str]) -> tuple[str | None, str | None]:
    """Of an impl's head: the trait, if there is one, and the type; without generics."""
    depth, names, before = 0, [], None
    for word in head:
        depth += (word == "<") - (word == ">")
        if word == "for" and not depth:
            before, names = (names[-1] if names else None), []
        elif word == "where" and not depth:
            break
        elif not depth and WORD.fullmatch(word):
            names.append(word)
    return before, names[-1] if names else None


def split(words: list[str]) -> list[list[str]]:
    """Parts of a list between commas, outside all brackets; angle brackets are those of generics."""
    out, depth = [[]], 0
    for w in words:
        depth += (w in ("(", "[", "{", "<")) - (w in (")", "]", "}", ">"))
        if w == "," and not depth:
            out.append([])
        else:
            out[-1].append(w)
    return [x for x in out if x]


def parameter(part: list[str], language: str) -> dict:
    """name and type of a parameter, without its default."""
    part = part[: part.index("=")] if "=" in part else part
    if language in ("java", "c"):  # the type comes first
        part = [w for w in part if w != "final"]
        name, kind = (part[-1], part[:-1]) if len(part) > 1 and WORD.fullmatch(part[-1]) else (None, part)
    elif language == "go":
        name, kind = part[0], part[1:]
    else:
        at = part.index(":") if ":" in part else len(part)
        name, kind = "".join(x + " " * (x in ("mut", "ref")) for x in part[:at]), part[at + 1 :]
    return {"name": name, "type": "".join(kind) or None}


def group(words: list[str], at: int, opener: str, closer: str) -> int:
    """The place of the closer of the opener at `at`, or the last place."""
    depth = 0
    for j in range(at, len(words)):
        depth += (words[j] == opener) - (words[j] == closer)
        if not depth:
            return j
    return len(words) - 1


def signature(own: Nodes, node: dict) -> dict:
    """generics, parameters (name and type) and returns of a function's or type's head."""
    end = node["body"] if node["body"] is not None else node["last"]
    words = [own.text[s:e] for _, _, s, e in own.tokens[node["keyword"] : end]]
    before = [own.token(i) for i in range(node["first"], node["keyword"])]
    at, generics, parameters, returns = 1, [], [], None
    if own.language == "go" and node["kind"] == "method_declaration":
        at = group(words, 1, "(", ")") + 1
    while node["kind"] != "impl_item" and at < len(words) and words[at] not in ("<", "(", "="):
        at += 1
    if "<" in before and own.language == "java":  # a method's generics stand before its type, whose own follow
        k = before.index("<")
        if k == 0 or before[k - 1] in MODIFIERS:
            close = group(before, k, "<", ">")
            generics, before = [" ".join(x) for x in split(before[k + 1 : close])], before[:k] + before[close + 1 :]
    if at < len(words) and words[at] == "<":
        close = group(words, at, "<", ">")
        generics, at = [" ".join(x) for x in split(words[at + 1 : close])], close + 1
    if at < len(words) and words[at] == "(" and node["kind"] != "struct_item":
        close = group(words, at, "(", ")")
        parameters, rest = [parameter(x, own.language) for x in split(words[at + 1 : close])], words[close + 1 :]
        if own.language in ("java", "c"):
            returns = "".join(w for w in before if w not in MODIFIERS and not w.startswith("@")) or None
        elif own.language == "go":
            returns = "".join(rest) or None
        elif rest and rest[0] in ("->", ":"):
            stop = next((j for j, w in enumerate(rest) if w in ("where", "{", ";")), len(rest))
            returns = "".join(rest[1:stop]) or None
    return {"generics": generics, "parameters": parameters, "returns": returns}


def imported(own: Nodes, node: dict) -> str | None:
    """What an import names: its strings, else the path behind its keyword."""
    words = [(k, t) for k, t, _, _ in own.tokens[node["keyword"] + 1 : node["last"] + 1]]
    strings = [t.strip("\"'`") for k, t in words if k == "string"]
    return ",".join(strings) or "".join(t for _, t in words if t not in (";", "static")) or None


ROW = "position long, parent long, level long, type string, kind string, name string, modifiers array<string>, generics array<string>, parameters array<struct<name:string,type:string>>, returns string, start long, end long, line long, end_line long"


def rows_of(text: str, language: str) -> list[dict]:
    own = Nodes(text, language)
    order = sorted(range(len(own.rows)), key=lambda k: (own.rows[k]["first"], k))  # a method's or an arrow function's start is known late
    place = {k: j for j, k in enumerate(order)}
    out = []
    for j, k in enumerate(order):
        x = own.rows[k]
        start, end = own.tokens[x["first"]][2], own.tokens[x["last"]][3]
        said = [own.token(i) for i in range(x["first"], x["keyword"])]
        if TYPES.get(x["kind"]) == "import":
            x["name"] = imported(own, x)
        typed = x["kind"] in MODIFIED or TYPES.get(x["kind"]) in ("function", "method")
        row = {"position": j, "parent": None if x["parent"] is None else place[x["parent"]], "level": x["level"], "type": TYPES.get(x["kind"], x["kind"]), "kind": x["kind"], "name": x["name"], "modifiers": [w for w in said if w in MODIFIERS], "start": start, "end": end, "line": own.line(start), "end_line": own.line(max(start, end - 1))}
        out.append(row | (signature(own, x) if typed else {"generics": [], "parameters": [], "returns": None}))
    return out


def nodes(files: DataFrame) -> DataFrame:
    """Rows of ROW for every node of files (path, language, content); other languages and null contents give none."""
    names = ["path", *(x.split()[0] for x in ROW.replace("array<struct<name:string,type:string>>", "x").split(", "))]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": path} | r for path, language, text in zip(batch["path"], batch["language"], batch["content"], strict=True) for r in rows_of(text, language)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.assign(parent=frame["parent"].astype("Int64"))

    own = files.where(F.col("language").isin(*KINDS)).select("path", "language", F.coalesce("content", F.lit("")).alias("content"))
    return own.mapInPandas(made, f"path string, {ROW}")


def figures(found: DataFrame) -> DataFrame:
    """Of nodes, by file: complexity (1 and one for each branch), how many nodes, the deepest level, and names of classes and functions in order."""
    named = lambda *kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("type").isin(*kinds) & F.col("name").isNotNull(), F.struct("position", "name")))), lambda x: x["name"])
    return found.groupBy("path").agg(
        (1.0 + F.count_if(F.col("kind").isin(*BRANCHES))).alias("complexity"), F.count("*").alias("n_nodes"), F.max("level").alias("deepest"),
        named("class", "struct").alias("classes"), named("function", "method").alias("functions"), F.count_if(F.col("type").isin("import", "include")).alias("n_imports"),
    )
