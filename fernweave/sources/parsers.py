"""Symbols and dependencies of source files.

Python goes by its own syntax tree. The languages with braces go by a masked text (comments and strings blanked out, so offsets
stay), declarations by pattern and their ends by matching braces; calls belong to the innermost function around them. Files
that fail give an error and what was found before it.
"""

from __future__ import annotations

import ast
import os
import pickle
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Imports that are not external (Python, C, C++) or are (Swift, Objective-C frameworks).
PYTHON_STDLIB = ["os", "sys", "re", "json", "time", "datetime", "collections", "itertools", "functools", "pathlib", "typing", "unittest", "logging", "math", "random", "string", "io", "subprocess"]
C_STDLIB = [
    "stdio.h", "stdlib.h", "string.h", "math.h", "time.h", "ctype.h", "stddef.h", "stdint.h", "stdbool.h", "assert.h", "errno.h", "limits.h",
    "float.h", "stdarg.h", "setjmp.h", "signal.h", "locale.h", "wchar.h", "wctype.h", "complex.h", "fenv.h", "inttypes.h", "iso646.h",
    "stdalign.h", "stdatomic.h", "stdnoreturn.h", "threads.h", "uchar.h",
]
SYSTEM_PREFIXES = ["sys/", "linux/", "unix/", "windows.h", "pthread.h", "unistd.h", "fcntl.h", "dirent.h"]
CPP_STDLIB = [
    "iostream", "fstream", "sstream", "iomanip", "string", "vector", "list", "map", "set", "queue", "stack", "deque", "array", "algorithm",
    "iterator", "functional", "memory", "utility", "tuple", "optional", "variant", "any", "chrono", "thread", "mutex", "condition_variable",
    "atomic", "future", "exception", "stdexcept", "typeinfo", "type_traits", "limits", "numeric", "cmath", "cstdlib", "cstdio", "cstring",
    "ctime", "cassert", "cerrno", "cctype", "cwchar", "cwctype", "regex", "random", "bitset", "complex", "valarray", "locale", "codecvt", "filesystem",
]
CPP_LIBRARIES = ["boost/", "Qt", "wx/", "gtk/", "SDL", "SFML/", "eigen", "opencv", "curl/", "json/", "yaml-cpp/", "protobuf/", "grpc/"]
SWIFT_FRAMEWORKS = ["Foundation", "UIKit", "SwiftUI", "Combine", "CoreData", "CoreGraphics", "CoreLocation", "MapKit", "AVFoundation", "WebKit", "AppKit", "Cocoa"]
OBJC_FRAMEWORKS = ["Foundation", "UIKit", "CoreData", "CoreGraphics", "CoreLocation", "MapKit", "AVFoundation", "WebKit", "AppKit", "Cocoa", "QuartzCore", "CoreAnimation", "CoreText", "Security", "SystemConfiguration"]

SCHEMA = (
    "path string, language string, symbols array<struct<name:string,raw_kind:string,signature:string,docstring:string,depth:int,start_line:int,end_line:int,start_byte:int,end_byte:int>>, "
    "dependencies array<struct<type:string,source:string,target:string,target_module:string,is_external:boolean>>, error string"
)


@dataclass
class Symbol:
    name: str
    raw_kind: str
    start: int
    end: int
    signature: str = ""
    docstring: str = ""


def base_package(name: str) -> str:
    return ".".join(name.split(".")[:2])


def is_external(language: str, name: str, package: str = "", system: bool = False) -> bool:
    if language == "Python":
        return not name.startswith(".") and name.split(".")[0] not in PYTHON_STDLIB
    if language == "Go":
        return "." in name and not (package and name.startswith(package))
    if language in ("JavaScript", "TypeScript"):
        return not name.startswith(("./", "../", "/"))
    if language in ("Java", "Kotlin"):
        own = ("java.", "javax.") if language == "Java" else ("kotlin.", "kotlinx.", "java.", "javax.")
        return not name.startswith(own) and not (package and base_package(package) == base_package(name))
    if language == "Swift":
        return any(name == f or name.startswith(f + ".") for f in SWIFT_FRAMEWORKS)
    if language == "Objective-C":
        return any(name.startswith(f + "/") or name == f + ".h" for f in OBJC_FRAMEWORKS)
    if language == "C++":
        if name in CPP_STDLIB:
            return False
        if system and (any(p in name for p in CPP_LIBRARIES) or any(name.startswith(p) for p in SYSTEM_PREFIXES)):
            return True
        return not (name.endswith((".h", ".hpp", ".hh", ".hxx")) and "/" not in name)
    if system or name in C_STDLIB:
        return False
    return any(name.startswith(p) for p in SYSTEM_PREFIXES) or not (name.endswith(".h") and "/" not in name)


def _python(text: str) -> tuple[list[Symbol], list[tuple]]:
    tree = ast.parse(text)
    lines = [0]
    for line in text.encode().split(b"\n"):
        lines.append(lines[-1] + len(line) + 1)
    at = lambda line, col: lines[line - 1] + col
    symbols, deps = [], []
    doc = ast.get_docstring(tree)
    module = "__module__" if doc else ""
    if doc:
        node = tree.body[0]
        symbols.append(Symbol(module, "module", at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset), "", doc))

    def visit(node: ast.AST, inside: str, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            name, kind = owner, inside
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                marks = {d.id for d in child.decorator_list if isinstance(d, ast.Name)}
                what = "async_" if isinstance(child, ast.AsyncFunctionDef) else ""
                raw = ("static_method" if "staticmethod" in marks else "class_method" if "classmethod" in marks else what + "method") if inside == "class" else what + "function"
                sign = f"{'async ' if what else ''}def {child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                symbols.append(Symbol(child.name, raw, at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset), sign, ast.get_docstring(child) or ""))
                name, kind = child.name, "function"
            elif isinstance(child, ast.ClassDef):
                symbols.append(Symbol(child.name, "class", at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset), f"class {child.name}", ast.get_docstring(child) or ""))
                for b in child.bases:
                    deps.append(("extends", child.name, ast.unparse(b), "", False))
                kind = "class"
            elif isinstance(child, ast.Import):
                for a in child.names:
                    if not a.asname:
                        deps.append(("import", module, a.name, a.name, is_external("Python", a.name)))
            elif isinstance(child, ast.ImportFrom) and child.module and not child.level:
                deps.append(("import", module, child.module, child.module, is_external("Python", child.module)))
            elif isinstance(child, ast.Call) and owner and isinstance(child.func, (ast.Name, ast.Attribute)):
                deps.append(("call", owner, ast.unparse(child.func), "", False))
            visit(child, kind, name)

    visit(tree, "", "")
    return symbols, deps


MASK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'", re.S)


def masked(text: str, strings: bool = True) -> str:
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if strings or m[0][:2] in ("//", "/*") else m[0]
    return MASK.sub(blank, text)


def braces(text: str) -> dict[int, int]:
    """The end of every block by its opening brace; unclosed ones end with the text."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out | {i: len(text) for i in open_}


N = r"[A-Za-z_$][\w$]*"
KEYWORDS = set("if for while switch catch return sizeof else do new throw case defer func function guard when try await yield typeof instanceof super synchronized assert alignof decltype static_cast dynamic_cast reinterpret_cast const_cast".split())
#: Declarations of a language: raw kind and pattern with a group `n`; those in FUNCTIONS are callers.
DECLARED: dict[str, list[tuple[str, str]]] = {
    "Go": [("package", rf"^package[ \t]+(?P<n>{N})"), ("method", rf"^func[ \t]*\([^)]*\)[ \t]*(?P<n>{N})[ \t]*(?:\[[^\]]*\])?\("), ("function", rf"^func[ \t]+(?P<n>{N})[ \t]*(?:\[[^\]]*\])?\("), ("struct", rf"^[ \t]*(?:type[ \t]+)?(?P<n>{N})(?:\[[^\]]*\])?[ \t]+struct\b"), ("interface", rf"^[ \t]*(?:type[ \t]+)?(?P<n>{N})[ \t]+interface\b"), ("type", rf"^type[ \t]+(?P<n>{N})[ \t]+(?!struct\b|interface\b)")],
    "JavaScript": [("async_function", rf"\basync[ \t]+function[ \t]*\*?[ \t]*(?P<n>{N})[ \t]*\("), ("generator_function", rf"(?<!async )\bfunction[ \t]*\*[ \t]*(?P<n>{N})[ \t]*\("), ("function", rf"(?<!async )\bfunction[ \t]+(?P<n>{N})[ \t]*(?:<[^>]*>)?\("), ("async_arrow_function", rf"\b(?:const|let|var)[ \t]+(?P<n>{N})[^=\n;]*=[ \t]*async[^=;\n]*=>"), ("arrow_function", rf"\b(?:const|let|var)[ \t]+(?P<n>{N})[^=\n;]*=[ \t]*(?!async)(?:\([^)]*\)|{N})[^=;\n]*=>"), ("class", rf"\bclass[ \t]+(?P<n>{N})"), ("static_method", rf"^[ \t]+static[ \t]+(?:async[ \t]+)?(?P<n>{N})[ \t]*\([^)]*\)[^;{{]*\{{"), ("async_method", rf"^[ \t]+async[ \t]+(?P<n>{N})[ \t]*\([^)]*\)[^;{{]*\{{"), ("method", rf"^[ \t]+(?:(?:public|private|protected|readonly|get|set)[ \t]+)*(?P<n>{N})[ \t]*\([^)]*\)[^;{{=]*\{{")],
    "Java": [("package", r"^package[ \t]+(?P<n>[\w.]+)"), ("annotation", rf"@interface[ \t]+(?P<n>{N})"), ("class", rf"\bclass[ \t]+(?P<n>{N})"), ("interface", rf"(?<!@)\binterface[ \t]+(?P<n>{N})"), ("enum", rf"\benum[ \t]+(?P<n>{N})"), ("method", rf"^[ \t]+(?:@\w+[ \t]+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)[ \t]+)*(?:<[^>]+>[ \t]+)?[\w.<>\[\], ?]+[ \t]+(?P<n>{N})[ \t]*\([^)]*\)[^;{{=]*[{{;]"), ("constructor", rf"^[ \t]+(?:public|private|protected)[ \t]+(?P<n>[A-Z]\w*)[ \t]*\([^)]*\)[^;{{]*\{{"), ("field", rf"^[ \t]+(?:(?:public|private|protected|static|final|volatile|transient)[ \t]+)+[\w.<>\[\], ?]+[ \t]+(?P<n>{N})[ \t]*(?:=|;)")],
    "Kotlin": [("package", r"^package[ \t]+(?P<n>[\w.]+)"), ("data_class", rf"\bdata[ \t]+class[ \t]+(?P<n>{N})"), ("sealed_class", rf"\bsealed[ \t]+class[ \t]+(?P<n>{N})"), ("annotation", rf"\bannotation[ \t]+class[ \t]+(?P<n>{N})"), ("class", rf"(?<!data )(?<!sealed )(?<!annotation )\bclass[ \t]+(?P<n>{N})"), ("interface", rf"\binterface[ \t]+(?P<n>{N})"), ("object", rf"\bobject[ \t]+(?P<n>{N})"), ("extension_function", rf"\bfun[ \t]+(?:<[^>]+>[ \t]*)?[\w<>?]+\.(?P<n>{N})[ \t]*\("), ("suspend_function", rf"\bsuspend[ \t]+fun[ \t]+(?P<n>{N})[ \t]*\("), ("function", rf"(?<!suspend )\bfun[ \t]+(?:<[^>]+>[ \t]*)?(?P<n>{N})[ \t]*\("), ("property", rf"^[ \t]*(?:(?:private|public|internal|protected|override|lateinit|const)[ \t]+)*(?:val|var)[ \t]+(?P<n>{N})")],
    "Swift": [("class", rf"\bclass[ \t]+(?!func\b|var\b)(?P<n>{N})"), ("struct", rf"\bstruct[ \t]+(?P<n>{N})"), ("enum", rf"\benum[ \t]+(?P<n>{N})"), ("protocol", rf"\bprotocol[ \t]+(?P<n>{N})"), ("extension", rf"\bextension[ \t]+(?P<n>[\w.]+)"), ("function", rf"\bfunc[ \t]+(?P<n>{N})[ \t]*(?:<[^>]+>)?[ \t]*\("), ("method", r"^[ \t]+(?:(?:public|private|convenience|required|override)[ \t]+)*(?P<n>init)[?!]?[ \t]*\("), ("property", rf"^[ \t]+(?:(?:public|private|fileprivate|internal|static|lazy|weak|override|@\w+)[ \t]+)*(?:let|var)[ \t]+(?P<n>{N})"), ("enum_case", rf"^[ \t]+(?:indirect[ \t]+)?case[ \t]+(?P<n>{N})(?![^\n]*:)")],
    "C": [("macro", rf"^[ \t]*#[ \t]*define[ \t]+(?P<n>{N})(?!\()"), ("function_macro", rf"^[ \t]*#[ \t]*define[ \t]+(?P<n>{N})\("), ("struct", rf"\bstruct[ \t]+(?P<n>{N})[ \t\n]*\{{"), ("union", rf"\bunion[ \t]+(?P<n>{N})[ \t\n]*\{{"), ("enum", rf"\benum[ \t]+(?P<n>{N})[ \t\n]*\{{"), ("typedef", rf"\btypedef\b[^;{{]*?(?P<n>{N})[ \t]*;"), ("typedef", rf"^\}}[ \t]*(?P<n>{N})[ \t]*;"), ("static_function", rf"^static[ \t][^;={{}}()#]*?[ \t*&](?P<n>{N})[ \t]*\([^;{{}}]*\)[ \t\n]*\{{"), ("function", rf"^(?!static\b)[A-Za-z_][^;={{}}()#]*?[ \t*&](?P<n>{N})[ \t]*\([^;{{}}]*\)[ \t\n]*(?:const[ \t\n]*)?\{{"), ("function_declaration", rf"^(?!return\b|typedef\b)[A-Za-z_][^;={{}}()#]*?[ \t*&](?P<n>{N})[ \t]*\([^;{{}}]*\)[ \t]*;"), ("extern_variable", rf"^extern[ \t]+[^;(]*?(?P<n>{N})[ \t]*(?:\[[^\]]*\])?;")],
    "Objective-C": [("category", rf"@interface[ \t]+\w+[ \t]*\([ \t]*(?P<n>{N})[ \t]*\)"), ("interface", rf"@interface[ \t]+(?P<n>{N})(?![ \t]*\()"), ("implementation", rf"@implementation[ \t]+(?P<n>{N})"), ("protocol", rf"@protocol[ \t]+(?P<n>{N})(?![ \t]*[;,])"), ("property", r"@property[^;]*?(?P<n>\w+)[ \t]*;")],
}
DECLARED["TypeScript"] = [*DECLARED["JavaScript"], ("interface", rf"\binterface[ \t]+(?P<n>{N})")]
DECLARED["C++"] = [
    ("namespace", rf"\bnamespace[ \t]+(?P<n>{N})"), ("class_template", rf"\btemplate[ \t]*<[^;{{]*>[ \t\n]*(?:class|struct)[ \t]+(?P<n>{N})"), ("class", rf"(?<!enum )\bclass[ \t]+(?P<n>{N})[^;<>()]*\{{"),
    ("operator", r"(?P<n>operator[ \t]*[^\s\w(]{1,3})[ \t]*\("), ("virtual_method", rf"^[ \t]+virtual[ \t][^;={{}}()]*?[ \t*&](?P<n>~?{N})[ \t]*\("),
    ("method", rf"^[ \t]*[\w:<>,*& ~]*?{N}::(?P<n>~?{N})[ \t]*\([^;{{}}]*\)[^;{{}}]*\{{"), ("method", rf"^[ \t]+(?!return\b|else\b|virtual\b|delete\b|throw\b|new\b)[\w:<>,*& ]*?[ \t*&](?P<n>{N})[ \t]*\([^;{{}}]*\)[ \t]*(?:const|override|noexcept|[ \t])*(?:\{{|;)"), *DECLARED["C"],
]
FUNCTIONS = {"function", "method", "async_function", "generator_function", "arrow_function", "async_arrow_function", "static_method", "async_method", "constructor", "extension_function", "suspend_function", "static_function", "virtual_method", "operator", "method_implementation", "inline_function", "function_template"}
TYPES = {"class", "struct", "interface", "enum", "protocol", "extension", "data_class", "sealed_class", "object", "implementation", "category", "class_template", "annotation"}
IMPORTS = {
    "Java": r"^import[ \t]+(?:static[ \t]+)?(?P<m>[\w.]+(?:\.\*)?)", "Kotlin": r"^import[ \t]+(?P<m>[\w.]+(?:\.\*)?)", "Swift": r"^(?:@testable[ \t]+)?import[ \t]+(?P<m>[\w.]+)",
    "C": r"^[ \t]*#[ \t]*include[ \t]*(?P<q>[<\"])(?P<m>[^>\"]+)", "Objective-C": r"^[ \t]*#[ \t]*(?:import|include)[ \t]*(?P<q>[<\"])(?P<m>[^>\"]+)",
    "JavaScript": r"\b(?:import\b[^;'\"\n]*?(?:from[ \t]*)?|export[^;'\"\n]*from[ \t]*|require[ \t]*\([ \t]*)['\"](?P<m>[^'\"\n]+)['\"]",
}
IMPORTS["C++"], IMPORTS["TypeScript"] = IMPORTS["C"], IMPORTS["JavaScript"]


def _objc_methods(text: str, ends: dict[int, int]) -> Iterator[Symbol]:
    for m in re.finditer(r"^[ \t]*[-+][ \t]*\([^)]*\)[ \t]*([^;{]*)([;{])", text, re.M):
        parts = re.findall(r"(\w+)[ \t]*:", m[1])
        name = "".join(p + ":" for p in parts) if parts else (re.match(r"\w+", m[1]) or [""])[0]
        if name:
            yield Symbol(name, "method_implementation" if m[2] == "{" else "method", m.start(), ends.get(m.end() - 1, m.end()), " ".join(m[0][:-1].split()))


def _braced(text: str, language: str, path: str) -> tuple[list[Symbol], list[tuple]]:
    plain = masked(text)
    ends = braces(plain)
    symbols: list[Symbol] = []
    taken: set[tuple[int, str]] = set()
    starts = sorted(ends)
    for raw, pattern in DECLARED[language]:
        for m in re.finditer(pattern, plain, re.M):
            kind = raw
            name = re.sub(r"\s+", "", m["n"])
            if name in KEYWORDS or (m.start("n"), "") in taken or re.match(r"\s*(?:return|else|new|throw|delete|await|case)\b", m[0]):
                continue
            taken.add((m.start("n"), ""))
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            end = m.end()
            if kind in FUNCTIONS or kind in TYPES or kind in ("namespace", "union"):
                at = bisect_right(starts, m.end() - 2)
                stop = plain.find(";", m.end() - 1)
                if at < len(starts) and (stop < 0 or starts[at] < stop or kind in TYPES and language in ("Kotlin", "Swift", "Go")):
                    gap = plain[m.end() : starts[at]] if starts[at] > m.end() else ""
                    if language not in ("Kotlin", "Swift") or not re.search(r"\n[ \t]*(?:[a-z]+[ \t]+)*(?:class|fun|func|val|var|let|object|interface|struct|enum|extension|protocol)\b", gap):
                        end = ends[starts[at]]
            if kind in ("function", "suspend_function") and language in ("Swift", "Kotlin") and any(s.raw_kind in TYPES and s.start < start < s.end for s in symbols):
                kind = kind.replace("function", "method")
            if kind == "method" and language in ("JavaScript", "TypeScript", "C++", "Java") and "::" not in m[0] and not any(s.raw_kind in TYPES and s.start < start < s.end for s in symbols):
                continue
            sign = " ".join(text[start : plain.find("{", start) if 0 <= plain.find("{", start) < end else end].split())[:500]
            symbols.append(Symbol(f"extension_{name}" if kind == "extension" else name, kind, start, end, sign.rstrip("; ")))
    if language == "Objective-C":
        symbols += list(_objc_methods(plain, ends))
    if language in ("JavaScript", "TypeScript"):
        symbols.insert(0, Symbol(re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), "module", 0, 0))
    symbols.sort(key=lambda s: (s.start, -s.end))
    deps: list[tuple] = []
    package = next((s.name for s in symbols if s.raw_kind == "package"), "")
    module = next((s.name for s in symbols if s.raw_kind in ("package", "module")), "")
    if language == "Go":
        for block in re.finditer(r"^import[ \t]*(?:\(([^)]*)\)|((?:\w+[ \t]+)?\"[^\"]+\"))", masked(text, False), re.M):
            for name in re.findall(r"\"([^\"]+)\"", block[1] or block[2]):
                deps.append(("import", module, name, name, is_external("Go", name)))
    elif language in IMPORTS:
        for m in re.finditer(IMPORTS[language], masked(text, False), re.M):
            system = "q" in m.re.groupindex and m["q"] == "<"
            deps.append(("import", "" if language in ("C", "C++") else module, m["m"], m["m"], is_external(language, m["m"], package, system)))
    for s in symbols:
        if s.raw_kind not in TYPES:
            continue
        head = plain[s.start : plain.find("{", s.start) if 0 <= plain.find("{", s.start) <= s.end else s.end]
        if language in ("Java", "JavaScript", "TypeScript"):
            if m := re.search(r"\bextends[ \t]+([\w.$]+)", head):
                deps.append(("extends", s.name, m[1], "", False))
            if (m := re.search(r"\bimplements[ \t]+([\w.$, ]+)", head)) and language == "Java":
                deps += [("implements", s.name, x.strip(), "", False) for x in m[1].split(",")]
        elif language in ("Kotlin", "Swift", "C++", "Objective-C"):
            tail = re.sub(r"\([^)]*\)", "", head).split(":", 1)
            if len(tail) == 2 and "::" not in head:
                names = [re.sub(r"\b(?:public|private|protected|virtual)\b", "", re.sub(r"<.*", "", x)).strip() for x in tail[1].split("\n")[0].split(",")]
                for k, x in enumerate(n for n in names if re.fullmatch(r"[\w.]+", n)):
                    deps.append(("conforms" if k and language == "Swift" or s.raw_kind in ("struct", "enum") and language == "Swift" else "extends", s.name, x, "", False))
            if language == "Objective-C" and (m := re.search(r"<([\w, ]+)>", head)):
                deps += [("conforms", s.name, x.strip(), "", False) for x in m[1].split(",")]
    if language == "Java":
        for m in re.finditer(r"@(\w+)", plain):
            if m[1] != "interface" and (to := next((s for s in symbols if s.start >= m.start() and s.raw_kind not in ("package",)), None)):
                deps.append(("annotated_with", to.name, m[1], "", False))
    if language in ("C", "C++") and re.search(r"\.(?:h|hpp|hh|hxx)$", path):
        return symbols, deps
    callers = [s for s in symbols if s.raw_kind in FUNCTIONS or s.raw_kind in ("suspend_method",)]
    for m in re.finditer(r"((?:[A-Za-z_$][\w$]*(?:\.|::|->|\?\.|!\.))*[A-Za-z_$][\w$]*)[ \t]*(?:<[\w, ]+>)?\(", plain):
        name = m[1]
        last = re.split(r"\.|::|->", name)[-1]
        if last in KEYWORDS or any(m.start(1) <= s.start + len(s.signature) and s.start <= m.start(1) and last == s.name for s in callers):
            continue
        owner = max((s for s in callers if s.start < m.start() < s.end), key=lambda s: s.start, default=None)
        if owner:
            target = last if language in ("Java", "Kotlin", "Swift") or language == "C++" and "::" not in name else name
            deps.append(("call", owner.name, target, "", False))
    if language == "Objective-C":
        for m in re.finditer(r"\[[ \t]*[\w.]+[ \t]+(\w+)((?:[ \t]*:[^\[\]:]*?(?=\w+[ \t]*:|\]))?(?:(\w+)[ \t]*:[^\[\]]*)?)\]", plain):
            owner = max((s for s in callers if s.start < m.start() < s.end), key=lambda s: s.start, default=None)
            if owner:
                parts = re.findall(r"(\w+)[ \t]*:", m[0])
                deps.append(("call", owner.name, "".join(p + ":" for p in parts) or m[1], "", False))
    return symbols, deps


def parse_text(path: str, language: str, content: bytes) -> dict:
    """One file's row of SCHEMA."""
    row: dict = {"path": path, "language": language, "symbols": [], "dependencies": [], "error": None}
    if not content:
        return row | {"error": "empty content"}
    text = content.decode("utf-8", "replace")
    try:
        if language == "Python":
            symbols, deps = _python(text)
        elif language in DECLARED:
            symbols, deps = _braced(text, language, path)
        else:
            return row | {"error": f"no parser for {language}"}
    except (SyntaxError, ValueError, RecursionError) as e:
        return row | {"error": f"{type(e).__name__}: {e}"}
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    ascii_ = text.isascii()
    for s in sorted(symbols, key=lambda s: (s.start, -s.end)):
        if language == "Python":  # offsets are bytes already
            first, last = content.count(b"\n", 0, s.start) + 1, content.count(b"\n", 0, s.end) + 1
            a, b = s.start, s.end
        else:
            first, last = bisect_right(starts, s.start), bisect_right(starts, max(s.start, s.end - 1))
            a, b = (s.start, s.end) if ascii_ else (len(text[: s.start].encode()), len(text[: s.end].encode()))
        depth = sum(o.start < s.start and s.end <= o.end for o in symbols)
        row["symbols"].append({"name": s.name, "raw_kind": s.raw_kind, "signature": s.signature, "docstring": s.docstring, "depth": depth, "start_line": first, "end_line": last, "start_byte": a, "end_byte": b})
    row["dependencies"] = [dict(zip(("type", "source", "target", "target_module", "is_external"), d)) for d in deps]
    return row


#: Files that one process of its own parses, at most.
FILES = 5_000


def _apart(parse: Callable[[], object]) -> object:
    """What parse returns, made in a forked process: Python never frees the names that its parser has seen, so workers that live
    through many files would grow with all names in them."""
    read, write = os.pipe()
    child = os.fork()
    if not child:
        code = 1
        try:
            os.close(read)
            with os.fdopen(write, "wb") as out:
                out.write(pickle.dumps(parse()))
            code = 0
        finally:
            os._exit(code)
    os.close(write)
    with os.fdopen(read, "rb") as got:
        data = got.read()
    if os.waitpid(child, 0)[1]:
        raise RuntimeError("a parsing process failed")
    return pickle.loads(data)


def parse(sources: DataFrame) -> DataFrame:
    """Rows of SCHEMA for sources(path, language, content). Partitions take the place of a pool of workers."""
    schema = to_arrow_schema(sources.sparkSession.createDataFrame([], SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), FILES):
                files = list(zip(*(whole[c].slice(lo, FILES).to_pylist() for c in ("path", "language", "content"))))
                rows = lambda: [parse_text(p, x, c or b"") for p, x, c in files]  # noqa: B023, E731
                yield pa.RecordBatch.from_pylist(_apart(rows) if any(x == "Python" for _, x, _ in files) else rows(), schema)

    return sources.select("path", "language", "content").mapInArrow(run, SCHEMA)
