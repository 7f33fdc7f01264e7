"""Languages of files: by extension, and for headers by content."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernweave.functions.text import extension

#: Extensions that count as binary, languages of extensions, and what marks a header's language.
BINARY = [
    ".exe", ".dll", ".so", ".dylib", ".jpg", ".jpeg", ".png", ".gif", ".pdf", ".zip", ".tar", ".gz",
    ".mp3", ".mp4", ".avi", ".mov", ".db", ".sqlite", ".ico", ".ttf", ".woff", ".woff2", ".eot", ".otf",
]
LANGUAGES = {
    ".go": "Go", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JavaScript", ".tsx": "TypeScript", ".py": "Python",
    ".kt": "Kotlin", ".kts": "Kotlin", ".java": "Java", ".swift": "Swift", ".m": "Objective-C", ".c": "C",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++", ".hh": "C++", ".hxx": "C++",
    ".rs": "Rust", ".php": "PHP", ".rb": "Ruby", ".sql": "SQL", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass",
    ".md": "Markdown", ".txt": "Text", ".json": "JSON", ".xml": "XML", ".yaml": "YAML", ".yml": "YAML",
}
OBJC_MARKS = [
    "@interface", "@implementation", "@protocol", "@property", "@synthesize", "@dynamic", "@class", "@selector", "@end",
    "#import <Foundation/", "#import <UIKit/", "#import <Cocoa/", "NS_ASSUME_NONNULL_BEGIN", "NS_ASSUME_NONNULL_END",
    "NSString", "NSArray", "NSDictionary", "NSObject",
]
CPP_MARKS = [
    "class ", "namespace ", "template<", "template <", "std::", "public:", "private:", "protected:", "virtual ", "override",
    "nullptr", "constexpr", "#include <iostream>", "#include <string>", "#include <vector>", "#include <map>", "using namespace",
    "::operator", "operator<<", "operator>>",
]
UNKNOWN = "Unknown"
HEADER_BYTES = 4096


def _any_of(marks: list[str]) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", m) for m in marks)


def is_binary(path: Column) -> Column:
    return F.lower(extension(path)).isin(BINARY)


def language(path: Column, content: Column | None = None) -> Column:
    """The language of a path; a header's by its first bytes, C without content."""
    ext = F.lower(extension(path))
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ext], F.lit(UNKNOWN))
    if content is None:
        return F.when(ext == ".h", "C").otherwise(named)
    head = F.substring(content, 1, HEADER_BYTES).cast("binary")
    head = F.decode(head, "ISO-8859-1")
    sniffed = F.when(head.rlike(_any_of(OBJC_MARKS)), "Objective-C").when(head.rlike(_any_of(CPP_MARKS)), "C++").otherwise("C")
    return F.when(ext == ".h", sniffed).otherwise(named)
