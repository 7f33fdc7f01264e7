"""Ignore rules as regular expressions over paths, applied in order inside the plan; the last rule that matches counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is ignored by default.
DEFAULTS = [
    ".git/", "node_modules/", "vendor/", "__pycache__/", "*.pyc", "*.exe", "*.dll", "*.so", "*.jpg", "*.jpeg", "*.png", "*.gif",
    "*.bmp", "*.pdf", "*.zip", "*.tar", "*.gz", "*.rar", "*.7z", "*.bin", "*.dat", "*.o", "*.a", "*.lib", "*.dylib",
]


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression; wildcards do not cross a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + body + "]"
            i = end + 1
        elif c == "\\" and i < len(pattern):
            out += "\\Q" + pattern[i] + "\\E"
            i += 1
        else:
            out += c if c.isalnum() or c in "_/ " else "\\" + c
    return out


def literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/ " else "\\" + c for c in text)


def rule(line: str) -> tuple[str, bool] | None:
    """(regular expression of whole paths, whether it ignores) of a line; None for blanks and comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    pattern = line.removeprefix("!").removesuffix("/")
    if "**" in pattern:
        parts = pattern.split("**")
        first, last = parts[0].removesuffix("/"), parts[-1].removeprefix("/")
        looks = ["^"]
        if first:
            looks.append(f"(?={literal(first)})")
        for part in parts[1:-1]:
            if part := part.strip("/"):
                looks.append(f"(?=(?:.*/)?{glob(part)}(?:/.*)?$)")
        if last and "/" in last:
            looks.append(f"(?=.*{literal(last)})")
        elif last:
            looks.append(f"(?=(?:(?:.*/)?{glob(last)}(?:/.*)?|.*{literal(last)})$)")
        return "".join(looks) + ".*$", ignores
    if pattern.startswith("/"):
        return f"^{glob(pattern[1:])}$", ignores
    below = f"{glob(pattern)}/.*" if "/" in pattern else f"(?:.*/)?{glob(pattern)}/.*"
    return f"^(?:(?:.*/)?{glob(pattern)}|{below})$", ignores


def rules(lines: list[str], defaults: bool = True) -> list[tuple[str, bool]]:
    return [r for r in map(rule, [*(DEFAULTS if defaults else []), *lines]) if r]


def ignored(path: Column, rules_: list[tuple[str, bool]]) -> Column:
    """Whether a path, or a folder above it, is ignored. A folder that is ignored hides what is below it, whatever comes after."""
    one = lambda p: reduce(lambda acc, r: F.when(p.rlike(r[0]), F.lit(r[1])).otherwise(acc), rules_, F.lit(False))
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.exists(above, one)
