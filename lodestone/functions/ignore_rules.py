"""Ignore files in the common syntax of one pattern a line, as a Column: the last matching rule decides, an ignored folder takes all below it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import paths


@dataclass(frozen=True)
class Rule:
    regex: str
    keep: bool  # from a leading !
    folder_only: bool


def regex_of(pattern: str) -> str:
    """A glob as a Java and Python expression: * and ? stay within a segment, ** crosses segments, [..] is a class."""
    out, i = "", 0
    while i < len(pattern):
        rest = pattern[i:]
        stop = pattern.find("]", i + 2) if rest[0] == "[" else -1
        if rest.startswith("**/") and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rest == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif stop > 0:
            body = pattern[i + 1 : stop].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", stop + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return out


def parse(text: str | None) -> list[Rule]:
    """The rules of one file; blank lines and # lines give none."""
    rules = []
    for line in (text or "").splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        keep = line.startswith("!")
        body = line[1:] if keep else line
        if not body or line.startswith("#"):
            continue
        folder_only = body.endswith("/")
        body = body.rstrip("/") if folder_only else body
        if not body:
            continue
        anchored = "/" in body
        inner = regex_of(body.lstrip("/"))
        rules.append(Rule(f"^{inner}$" if anchored else f"^(?:.*/)?{inner}$", keep, folder_only))
    return rules


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Is path (relative to the root, forward slashes) or a folder above it ignored? rules in file order, the highest-priority file last; null: null."""
    if not rules:
        return F.when(path.isNotNull(), F.lit(False))

    def last_match(p: Column, among: list[Rule]) -> Column:
        if not among:
            return F.lit(False)
        out = None
        for r in reversed(among):
            out = F.when(p.rlike(r.regex), F.lit(not r.keep)) if out is None else out.when(p.rlike(r.regex), F.lit(not r.keep))
        return out.otherwise(F.lit(False))

    files = [r for r in rules if not r.folder_only]
    return F.exists(paths.prefixes(path), lambda p: last_match(p, files) | last_match(p, rules))
