"""C++ symbols from source text: one pass over tokens with a stack of brace scopes, no grammar.

`symbols` gives a row per class, struct, enum, global, define, delegate, log category or namespace of gameplay tags, with its members; `includes` is built-in expressions only;
`calls` gives call sites. A file is parsed in one Python call, whatever its size; files are independent, so nothing shuffles.

Defined cases: null or empty content has no symbols; forward declarations are no symbols; unbalanced braces end at the end of the file;
a member of an out-of-class definition goes to the class of that name in the file, or to a class row made for it (line 1).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""(?P<skip>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|\s+)|(?P<pre>^[ \t]*\#(?:\\\r?\n|[^\n])*)|(?P<text>R"(?P<d>[^()\s]*)\(.*?\)(?P=d)"|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<number>\d[\w.']*)|(?P<mark>::|->|.)""",
    re.S | re.X | re.M,
)
DEFINE = re.compile(r"\s*#\s*define\s+([A-Za-z_]\w*)")

# Macros that mark symbols and members, and words that are no part of a type.
KINDS = {"UCLASS": "UCLASS", "UINTERFACE": "UCLASS", "USTRUCT": "USTRUCT", "UENUM": "UENUM"}
MEMBER_MACROS = ("UFUNCTION", "UPROPERTY")
DELEGATE = re.compile(r"DECLARE_(?:DYNAMIC_|MULTICAST_|DYNAMIC_MULTICAST_|SPARSE_DYNAMIC_(?:MULTICAST_)?|TS_MULTICAST_)?DELEGATE|DECLARE_EVENT")
LOG_MACROS = ("DECLARE_LOG_CATEGORY_EXTERN", "DEFINE_LOG_CATEGORY", "DEFINE_LOG_CATEGORY_STATIC")
TAG_MACROS, TAG_TYPE = ("UE_DEFINE_GAMEPLAY_TAG", "UE_DECLARE_GAMEPLAY_TAG"), "GameplayTag"
NO_TYPE = {"virtual", "static", "inline", "FORCEINLINE", "const", "constexpr", "explicit", "friend", "mutable", "extern", "class", "struct", "enum", "typename", "volatile"}
NO_CALL = {"if", "for", "while", "switch", "return", "sizeof", "catch", "alignof", "decltype", "defined"}
MACRO = re.compile(r"[A-Z][A-Z0-9_]{2,}$")

MEMBER = "struct<name:string,type:string,flags:string,access:string,line:int,end_line:int,detail:string,return_type:string>"
SYMBOL = f"name string, namespace string, symbol_type string, bases array<string>, line int, end_line int, members array<{MEMBER}>"
PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int = 0  # from 0, in its line


@dataclass
class Symbol:
    name: str
    namespace: str | None
    symbol_type: str
    line: int
    end_line: int
    bases: list[str] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)


@dataclass
class Scope:
    kind: str  # file, namespace, class, enum, open (extern "C")
    name: str = ""
    symbol: Symbol | None = None
    access: str = "public"
    line: int = 0


def tokens(text: str) -> list[Token]:
    line, out = 1, []
    for m in TOKEN.finditer(text):
        if m.lastgroup != "skip" and not m.group("skip"):
            kind = next(k for k in ("pre", "text", "word", "number", "mark") if m.group(k) is not None)
            out.append(Token(kind, m.group(), line, m.start() - text.rfind("\n", 0, m.start()) - 1))
        line += m.group().count("\n")
    return out


def closing(toks: list[Token], at: int) -> int:
    """Index of the mark that closes toks[at], or the last index."""
    opening, depth = toks[at].text, 0
    close = PAIRS[opening]
    for i in range(at, len(toks)):
        if toks[i].kind == "mark":
            depth += (toks[i].text == opening) - (toks[i].text == close)
            if not depth:
                return i
    return len(toks) - 1


def spelled(toks: list[Token]) -> str:
    """Tokens as text: a space between words only."""
    out = ""
    for t in toks:
        out += (" " if out and (out[-1].isalnum() or out[-1] in "_*&,>") and (t.text[0].isalnum() or t.text[0] == "_") else "") + t.text
    return out


def arguments(toks: list[Token]) -> list[str]:
    """Top-level comma-separated arguments of a bracketed run, brackets included."""
    parts, depth = [[]], 0
    for t in toks[1:-1]:
        depth += (t.text in ("(", "[", "{", "<")) - (t.text in (")", "]", "}", ">"))
        if t.text == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [spelled(p) for p in parts if p]


class File:
    def __init__(self, text: str) -> None:
        self.toks = tokens(text)
        self.symbols: list[Symbol] = []
        self.scopes = [Scope("file")]
        self.at = 0
        self.run()

    # the walk

    def run(self) -> None:
        head: list[Token] = []
        while self.at < len(self.toks):
            t, scope = self.toks[self.at], self.scopes[-1]
            if t.kind == "pre":
                self.define(t, scope)
            elif scope.kind == "enum" and t.text in (",", "}"):
                self.item(head, scope)
                head = []
                if t.text == "}":
                    self.leave(t)
            elif t.text == "}":
                self.leave(t)
                head = []
            elif t.text == ";":
                self.statement(head, t.line, body=False)
                head = []
            elif t.text == ":" and len(head) >= 1 and head[0].text in ("public", "protected", "private") and scope.kind == "class":
                scope.access, head = head[0].text, []
            elif t.text == "(":
                end = closing(self.toks, self.at)
                if self.macro(head, self.toks[self.at : end + 1], scope):
                    head = []
                else:
                    head += self.toks[self.at : end + 1]
                self.at = end
            elif t.text == "{":
                head = self.enter(head)
            else:
                head.append(t)
            self.at += 1
        for scope in self.scopes:
            if scope.symbol and self.toks:
                scope.symbol.end_line = max(scope.symbol.end_line, self.toks[-1].line)

    def leave(self, t: Token) -> None:
        if len(self.scopes) > 1:
            done = self.scopes.pop()
            if done.symbol:
                done.symbol.end_line = t.line

    def enter(self, head: list[Token]) -> list[Token]:
        """At an opening brace: a scope, a function body or an initialiser. Gives the head that goes on after it."""
        decl, marks = self.stripped(head)
        words = [t.text for t in decl]
        if words[:1] == ["namespace"] or words[:2] == ["inline", "namespace"]:
            self.scopes.append(Scope("namespace", spelled([t for t in decl if t.text not in ("inline", "namespace")]), line=decl[0].line))
            return []
        if words[:1] == ["extern"] and len(decl) == 2 and decl[1].kind == "text":
            self.scopes.append(Scope("open"))
            return []
        key = self.type_key(decl)
        if key is not None:
            self.open_type(decl[key:], marks)
            return []
        end = closing(self.toks, self.at)
        if "(" in words and "=" not in self.outside(decl):
            last, self.at = self.toks[end].line, end
            self.statement(head, last, body=True)
            return []
        self.at = end
        return head if words else []

    @staticmethod
    def outside(decl: list[Token]) -> list[str]:
        """Marks and words outside round brackets; operator= is no assignment."""
        out, depth = [], 0
        for i, t in enumerate(decl):
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0 and not (t.text in "=<>!+-*/" and any(x.text == "operator" for x in decl[max(0, i - 2) : i])):
                out.append(t.text)
        return out

    @staticmethod
    def type_key(decl: list[Token]) -> int | None:
        """Where class, struct or enum starts a definition; angle brackets of templates are passed."""
        depth = 0
        for i, t in enumerate(decl):
            depth += (t.text == "<") - (t.text == ">")
            if depth == 0 and t.text in ("class", "struct", "enum"):
                rest, inner = decl[i + 1 :], 0
                for x in rest:
                    inner += (x.text == "<") - (x.text == ">")
                    if x.text == ":" and inner == 0:
                        break
                    if x.text in ("(", "=") and inner == 0 and "alignas" not in [y.text for y in rest[:2]]:
                        return None
                return i
            if t.text == "(":
                return None
        return None

    @staticmethod
    def stripped(head: list[Token]) -> tuple[list[Token], list[str]]:
        """The head without leading macro calls, and their names."""
        marks, i = [], 0
        while i < len(head):
            if head[i].kind == "word" and MACRO.match(head[i].text) and i + 1 < len(head) and head[i + 1].text == "(":
                end = closing(head, i + 1)
                if end + 1 >= len(head) and head[i].text not in MEMBER_MACROS and head[i].text not in KINDS:
                    break
                marks.append(head[i].text)
                i = end + 1
            elif head[i].text == "template" and i + 1 < len(head) and head[i + 1].text == "<":
                depth = 0
                for j in range(i + 1, len(head)):
                    depth += (head[j].text == "<") - (head[j].text == ">")
                    if depth == 0:
                        break
                i = j + 1
            elif head[i].text == "[" and i + 1 < len(head) and head[i + 1].text == "[":
                i = closing(head, i) + 1
            else:
                break
        return head[i:], marks

    # what statements give

    def namespace(self) -> str | None:
        return "::".join(s.name for s in self.scopes if s.kind in ("namespace", "class") and s.name) or None

    def open_type(self, decl: list[Token], marks: list[str]) -> None:
        kind, colon = decl[0].text, next((i for i, t in enumerate(decl) if t.text == ":"), len(decl))
        names = [t for t in decl[1:colon] if t.kind == "word" and t.text not in ("class", "struct", "final", "alignas") and not t.text.endswith("_API")]
        if not names:
            self.scopes.append(Scope("enum" if kind == "enum" else "class", access="private" if kind == "class" else "public"))
            return
        name, space = names[0].text if kind == "enum" or "<" in [t.text for t in decl[1:colon]] else names[-1].text, self.namespace()
        if kind == "enum" and name == "Type" and space:
            name = f"{space}::Type"
        symbol = Symbol(name, space, next((KINDS[m] for m in marks if m in KINDS), kind), names[0].line, names[0].line)
        if kind != "enum":
            symbol.bases = self.base_names(decl[colon + 1 :], name)
        self.symbols.append(symbol)
        self.scopes.append(Scope("enum" if kind == "enum" else "class", names[-1].text, symbol, "private" if kind == "class" else "public"))

    @staticmethod
    def base_names(decl: list[Token], own: str) -> list[str]:
        out, name, depth = [], "", 0
        for t in [*decl, Token("mark", ",", 0)]:
            depth += (t.text == "<") - (t.text == ">")
            if t.text == "," and depth == 0:
                if name and name != own:
                    out.append(name)
                name = ""
            elif depth == 0 and t.kind == "word" and t.text not in ("public", "protected", "private", "virtual"):
                name = t.text
        return out

    def define(self, t: Token, scope: Scope) -> None:
        m = DEFINE.match(t.text)
        if m and scope.kind == "file":
            self.symbols.append(Symbol(m.group(1), None, "define", t.line, t.line))

    def macro(self, head: list[Token], args: list[Token], scope: Scope) -> bool:
        """A macro call that declares a symbol, or a body macro without a semicolon."""
        if len(head) != 1:
            return False
        name, parts = head[0].text, arguments(args)
        place = (1 if "RetVal" in name or name.startswith("DECLARE_EVENT") else 0) if DELEGATE.match(name) else 0 if name in LOG_MACROS else None
        if place is not None:
            if place < len(parts):
                self.symbols.append(Symbol(parts[place], None, "log_category" if name in LOG_MACROS else "delegate", head[0].line, head[0].line))
            return True
        if name.startswith(TAG_MACROS) and scope.kind == "namespace" and parts:
            detail = " — ".join(p.strip('"') for p in parts[1:3])
            self.tag(parts[0], head[0].line, args[-1].line, detail or None, "FGameplayTag")
            return True
        return name.startswith("GENERATED_")

    def tag(self, name: str, line: int, last: int, detail: str | None, kind: str) -> None:
        """A member of the innermost namespace, which becomes a symbol with its first tag."""
        scope = self.scopes[-1]
        if scope.symbol is None:
            outer = [s.name for s in self.scopes[:-1] if s.kind == "namespace" and s.name]
            path, _, own = scope.name.rpartition("::")
            scope.symbol = Symbol(own, "::".join([*outer, path] if path else outer) or None, "namespace", scope.line, scope.line)
            self.symbols.append(scope.symbol)
        scope.symbol.members.append(self.member(name, "property", "static", "public", line, last, detail, kind))

    def item(self, head: list[Token], scope: Scope) -> None:
        first = next((t for t in head if t.kind == "word"), None)
        if first and scope.symbol:
            scope.symbol.members.append(self.member(first.text, "enum_item", "", "public", first.line, head[-1].line, None, None))

    @staticmethod
    def member(name, kind, flags, access, line, end_line, detail, return_type) -> dict:
        return {"name": name, "type": kind, "flags": flags, "access": access, "line": line, "end_line": end_line, "detail": detail, "return_type": return_type}

    def statement(self, head: list[Token], last: int, body: bool) -> None:
        decl, marks = self.stripped(head)
        scope = self.scopes[-1]
        if not decl or scope.kind == "enum" or decl[0].text in ("typedef", "friend", "return", "goto", "static_assert", "namespace"):
            return
        if decl[0].text == "using":
            if len(decl) > 3 and decl[1].kind == "word" and decl[2].text == "=":
                target = spelled(decl[3:])
                self.put(self.member(decl[1].text, "type_alias", "", scope.access, decl[0].line, last, target, target), None)
            return
        if decl[0].text in ("class", "struct", "enum") and len(decl) <= 3:
            return  # a forward declaration, or an elaborated type without a name
        stop, depth, paren = len(decl), 0, None
        for i, t in enumerate(decl):
            depth += (t.text == "<") - (t.text == ">" and depth > 0)
            if depth == 0 and t.text == "(" and i and (decl[i - 1].kind == "word" or "operator" in [x.text for x in decl[max(0, i - 3) : i]]):
                paren = stop = i
                break
            if depth == 0 and t.text in ("=", "[", ":") and "operator" not in [x.text for x in decl[max(0, i - 2) : i]]:
                stop = i
                break
        if stop == 0:
            return
        place = stop - 1
        if "operator" in [t.text for t in decl[:stop]]:
            place = next(i for i, t in enumerate(decl[:stop]) if t.text == "operator")
        name_at = place
        owner = None
        name = spelled(decl[place:stop])
        if decl[place].kind != "word" or name in ("virtual", "static", "void", "const"):
            return
        if name_at and decl[name_at - 1].text == "~":
            name, name_at = f"~{name}", name_at - 1
        while name_at > 1 and decl[name_at - 1].text == "::" and decl[name_at - 2].kind == "word":
            owner, name_at = owner or decl[name_at - 2].text, name_at - 2
        before = decl[:name_at]
        tagged = next((t.text for t in before if TAG_TYPE in t.text), None)
        if tagged and before[0].text == "extern" and scope.kind == "namespace" and scope.name:
            self.tag(name, decl[0].line, last, None, tagged)
        function = (paren is not None or "UFUNCTION" in marks) and "UPROPERTY" not in marks
        if not function and not before:
            return  # an expression
        flags = [m for m in MEMBER_MACROS if m in marks] + (["static"] if any(t.text == "static" for t in before) else [])
        kept = [t for t in before if t.text not in NO_TYPE and not t.text.endswith("_API")]
        words = spelled(kept)
        returns = words if "<" in words else next((t.text for t in reversed(kept) if t.kind == "word"), None)
        detail = spelled(decl[paren : closing(decl, paren) + 1]) if function and paren is not None else None
        access = scope.access if scope.kind == "class" else "public"
        self.put(self.member(name, "function" if function else "property", " ".join(flags), access, (decl[0] if not marks else head[0]).line, last, detail, returns or None), owner)

    def put(self, member: dict, owner: str | None) -> None:
        scope = self.scopes[-1]
        if owner is not None:
            home = next((s for s in self.symbols if s.name == owner), None)
            if home is None:
                home = Symbol(owner, None, "class", 1, 999999)
                self.symbols.append(home)
            home.members.append(member | {"access": "impl"})
        elif scope.kind == "class":
            if scope.symbol:
                scope.symbol.members.append(member)
        else:
            kind = {"function": "global_function", "type_alias": "type_alias"}.get(member["type"], "global_var")
            self.symbols.append(Symbol(member["name"], None, kind, member["line"], member["end_line"]))


def parse(text: str | None) -> list[Symbol]:
    return File(text).symbols if text else []


def call_sites(text: str | None) -> list[tuple[str, int]]:
    """(name, line) of each word before a round bracket that is no keyword; preprocessor lines have none."""
    toks = tokens(text or "")
    return [(t.text, t.line) for t, u in zip(toks, toks[1:], strict=False) if t.kind == "word" and u.text == "(" and t.text not in NO_CALL]


def symbols(files: DataFrame) -> DataFrame:
    """path and the columns of SYMBOL for files(path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "name", "namespace", "symbol_type", "bases", "line", "end_line", "members"]
        for b in batches:
            rows = [(p, s.name, s.namespace, s.symbol_type, s.bases, s.line, s.end_line, s.members) for p, text in zip(b["path"], b["content"], strict=True) for s in parse(text)]
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content")).mapInPandas(run, f"path string, {SYMBOL}")


def calls(files: DataFrame) -> DataFrame:
    """path, name, line of every call site of files(path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *c) for p, text in zip(b["path"], b["content"], strict=True) for c in call_sites(text)], columns=["path", "name", "line"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content")).mapInPandas(run, "path string, name string, line int")


def words(files: DataFrame) -> DataFrame:
    """path, name, line: each identifier of files(path, content) with the line where it first stands; comments, texts and preprocessor lines have none."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                first: dict[str, int] = {}
                for t in tokens(text or ""):
                    if t.kind == "word":
                        first.setdefault(t.text, t.line)
                rows += [(path, name, line) for name, line in first.items()]
            yield pd.DataFrame(rows, columns=["path", "name", "line"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content")).mapInPandas(run, "path string, name string, line int")


def references(files: DataFrame, name: str, owner: str | None = None) -> DataFrame:
    """path, line, column, context of each use of an identifier in files(path, content); the name of a class, struct or enum where it is defined or declared is no use.

    With an owner the name is a member's, and its uses are x.name, x->name and Owner::name. Files without the bytes of the name are dropped before Python sees them."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                lines, before, earlier = text.split("\n"), "", ""
                for t in tokens(text):
                    used = before not in ("class", "struct", "enum") if owner is None else before in (".", "->") or (before == "::" and earlier == owner)
                    if t.text == name and used:
                        rows.append((path, t.line, t.column, lines[t.line - 1].strip()))
                    if not (MACRO.match(t.text) and t.text.endswith("_API")):
                        before, earlier = t.text, before
            yield pd.DataFrame(rows, columns=["path", "line", "column", "context"])

    held = files.where(F.col("content").contains(name)).select(F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content"))
    return held.mapInPandas(run, "path string, line int, column int, context string")


def includes(files: DataFrame) -> DataFrame:
    """path, include_path, base_filename: one row per include line, in built-in expressions."""
    found = F.regexp_extract_all("content", F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*["<]([^">\n]+)'), 1)
    return files.select("path", F.explode(found).alias("include_path")).withColumn("base_filename", F.substring_index("include_path", "/", -1))


# What a header holds that has anything to index.
SIGNS = ["UCLASS(", "USTRUCT", "DECLARE", "include", "#define", "GAMEPLAY_TAG"]


def worth_parsing(path: Column, content: Column) -> Column:
    """False for headers without a sign of an indexed symbol, which a fast scan passes over; true for all other files."""
    held = F.lit(False)
    for sign in SIGNS:
        held = held | content.contains(sign)
    return ~F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("h", "hpp", "inl") | F.coalesce(held, F.lit(False))


def index_tables(files: DataFrame) -> dict[str, DataFrame]:
    """The index's tables of files(path, content), keyed by path and name: classes, members, enum_values, inheritance, file_includes."""
    found = symbols(files)
    item = F.explode("members").alias("m")
    members = found.select("path", F.col("name").alias("class_name"), item).select("path", "class_name", "m.*")
    return {
        "classes": found.select("path", "name", "namespace", F.try_element_at("bases", F.lit(1)).alias("base_class"), "line", "end_line", "symbol_type"),
        "members": members.where("type != 'enum_item'").withColumn("is_static", F.col("flags").contains("static")),
        "enum_values": members.where("type = 'enum_item'").select("path", F.col("class_name").alias("enum_name"), "name", "line"),
        "inheritance": found.select("path", F.col("name").alias("child_name"), F.explode("bases").alias("parent_name")),
        "file_includes": includes(files),
    }
