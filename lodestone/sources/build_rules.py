"""Dependencies in module rules files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)//.*$", "")


def dependencies(text: Column, scope: str) -> Column:
    """Module names that scope (Public or Private) dependency calls add, distinct and sorted; calls may span lines."""
    plain = without_comments(text)
    lists = F.regexp_extract_all(plain, F.lit(rf"(?s){scope}DependencyModuleNames\s*\.\s*Add(?:Range)?\s*\(([^;]*?)\)\s*;"), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r'"([^"]+)"'), F.lit(1))))
    return F.array_sort(F.array_distinct(names))


def parse(files: DataFrame) -> DataFrame:
    """(path, module, public, private) of rules files (path, content)."""
    return files.select("path", F.regexp_extract("content", r"class\s+(\w+)\s*:\s*ModuleRules", 1).alias("module"), dependencies(F.col("content"), "Public").alias("public"), dependencies(F.col("content"), "Private").alias("private"))
