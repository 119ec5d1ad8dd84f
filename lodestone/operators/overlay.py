"""Layered configuration: INI lines, the ordered fold of their operations, histories, display, and layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ini(files: DataFrame) -> DataFrame:
    """(platform, stack_rank, file, section, key, op, value, line) of files (platform, stack_rank, file, content); op is '', '+', '-' or '!'.

    The section is carried by a fold over the file's own lines: no window, no shuffle."""
    lines = F.filter(
        F.transform(F.split("content", r"\r?\n"), lambda text, i: F.struct((i + 1).alias("line"), F.trim(text).alias("text"))),
        lambda x: (x["text"] != "") & ~x["text"].rlike("^[;#]"),
    )
    start = F.struct(F.lit("Default").alias("section"), F.array().cast("array<struct<section:string,line:int,text:string>>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        header = x["text"].rlike(r"^\[.*\]$")
        section = F.when(header, F.regexp_extract(x["text"], r"^\[(.*)\]$", 1)).otherwise(acc["section"])
        added = F.when(header, acc["rows"]).otherwise(F.concat(acc["rows"], F.array(F.struct(acc["section"].alias("section"), x["line"].alias("line"), x["text"].alias("text")))))
        return F.struct(section.alias("section"), added.alias("rows"))

    rows = files.select("platform", "stack_rank", "file", F.explode(F.aggregate(lines, start, step)["rows"]).alias("r"))
    key = F.trim(F.substring_index("r.text", "=", 1))
    value = F.when(F.col("r.text").contains("="), F.trim(F.regexp_replace("r.text", "^[^=]*=", ""))).otherwise("")
    return rows.select(
        "platform", "stack_rank", "file", F.col("r.section").alias("section"), F.trim(F.regexp_replace(key, r"^[+\-!]", "")).alias("key"),
        F.regexp_extract(key, r"^([+\-!]?)", 1).alias("op"), F.regexp_replace(value, '^"(.*)"$', "$1").alias("value"), F.col("r.line").alias("line"),
    )


def applied(values: Column, op: Column, value: Column) -> Column:
    """One operation on the list of values: set, + append, - remove, ! clear."""
    return F.when(op == "!", F.array().cast("array<string>")).when(op == "+", F.concat(values, F.array(value))).when(op == "-", F.array_remove(values, value)).otherwise(F.array(value))


def fold(lines: DataFrame, keys: list[str], order: list[str], history: bool = False) -> DataFrame:
    """keys, the final `values` after applying (op, value) in order, and the number of `steps`; with `history`, the values after each step, where asked for: its size is
    the square of a key's appends. A key's operations meet in one row."""
    steps = F.array_sort(F.collect_list(F.struct(*order, "op", "value")))
    empty = F.array().cast("array<string>")
    grouped = lines.groupBy(*keys).agg(steps.alias("steps"))
    count = F.size("steps").cast("long").alias("steps")
    if not history:
        final = F.aggregate("steps", empty, lambda now, x: applied(now, x["op"], x["value"]))
        return grouped.select(*keys, final.alias("values"), count)
    start = F.struct(empty.alias("now"), F.array().cast("array<array<string>>").alias("history"))

    def step(acc: Column, x: Column) -> Column:
        now = applied(acc["now"], x["op"], x["value"])
        return F.struct(now.alias("now"), F.concat(acc["history"], F.array(now)).alias("history"))

    both = grouped.withColumn("f", F.aggregate("steps", start, step))
    return both.select(*keys, F.col("f.now").alias("values"), count, F.col("f.history").alias("history"))


def nested(lines: DataFrame) -> DataFrame:
    """One row per platform: name and its sections, sorted, each with its parameters, sorted, each with the displayed value and what each line made of it.
    lines: platform, stack_rank, file, section, key, op, value, line. A platform without a line has no row here."""
    folded = fold(lines, ["platform", "section", "key"], ["stack_rank", "line"], True)
    named = lines.groupBy("platform", "section", "key").agg(F.array_sort(F.collect_list(F.struct("stack_rank", "line", "file", "op"))).alias("at"))
    made = F.zip_with("at", "history", lambda a, v: F.struct(a["file"].alias("file"), shown(v).alias("value"), a["op"].alias("op"), a["line"].alias("line")))
    rows = folded.join(named, ["platform", "section", "key"]).select("platform", "section", "key", shown(F.col("values")).alias("value"), made.alias("history"))
    sections = rows.groupBy("platform", "section").agg(F.array_sort(F.collect_list(F.struct("key", "value", "history"))).alias("parameters"))
    return sections.groupBy(F.col("platform").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col("section").alias("name"), "parameters"))).alias("sections"))


def shown(values: Column) -> Column:
    """A list as display text: nil, the value, or [Array xN] and the last; over 50 characters cut to 47 and dots."""
    last = F.element_at(values, -1)
    text = F.when(F.size(values) == 0, "nil").when(F.size(values) == 1, last).otherwise(F.concat(F.lit("[Array x"), F.size(values).cast("string"), F.lit("] "), last))
    return F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 47), F.lit("..."))).otherwise(text)


def layered(settings: DataFrame) -> DataFrame:
    """path -> value of the highest layer, of (layer, path, value)."""
    return settings.groupBy("path").agg(F.max_by("value", "layer").alias("value"))
