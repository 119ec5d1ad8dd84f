"""Full-text search over token tables, byte search, and link extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens_of(column: Column) -> Column:
    """Letters and digits, case-folded, diacritics apart: the default splitting of common full-text indexes."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_table(df: DataFrame, ref: str, columns: list[str]) -> DataFrame:
    """(ref, column, pos, token)."""
    parts = [df.select(F.col(ref).alias("ref"), F.lit(c).alias("column"), F.posexplode(tokens_of(F.col(c))).alias("pos", "token")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_match(pattern: str) -> list[tuple[str, list[str]]]:
    """Terms of a MATCH pattern: ('word', [w]), ('prefix', [w]) for w*, ('phrase', words) for "a b"."""
    out: list[tuple[str, list[str]]] = []
    for phrase, word in re.findall(r'"([^"]*)"|(\S+)', pattern):
        words = [w for w in re.split(r"[^\w]+", (phrase or word).lower()) if w]
        if words:
            out.append(("phrase" if phrase and len(words) > 1 else "prefix" if word.endswith("*") else "word" if len(words) == 1 else "phrase", words))
    return out


def _term(tokens: Column, kind: str, words: list[str]) -> Column:
    if kind == "word":
        return F.array_contains(tokens, words[0])
    if kind == "prefix":
        return F.exists(tokens, lambda t: t.startswith(words[0]))
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")


def match(df: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Rows of df for which every term of the pattern holds in one of the columns. A filter that splits each text once, for all terms: no shuffle.
    For many searches over the same rows write `token_index` and use `match_index`."""
    terms = parse_match(pattern)
    if not terms:
        return df.where(F.lit(False))
    texts = F.array(*(tokens_of(F.coalesce(F.col(c), F.lit(""))) for c in columns))

    def holds(split: Column) -> Column:
        every = F.lit(True)
        for kind, words in terms:
            one = F.lit(False)
            for i in range(len(columns)):
                one = one | _term(split[i], kind, words)
            every = every & one
        return every

    return df.where(F.exists(F.array(texts), holds))  # the split texts are one value here, so they are made once


def token_index(df: DataFrame, ref: str, columns: list[str], folder: str) -> DataFrame:
    """The token table, written in order of tokens, so that a search reads the row groups of its terms only."""
    token_table(df, ref, columns).repartitionByRange("token", "ref").sortWithinPartitions("token", "ref").write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def match_index(index: DataFrame, pattern: str) -> DataFrame:
    """(ref): what `match` finds, from a token table (ref, column, pos, token). Each term reads its tokens; refs that have all terms are counted, no text is read."""
    terms = parse_match(pattern)
    found = None
    for at, (kind, words) in enumerate(terms):
        if kind == "prefix":
            hits = index.where(F.col("token").startswith(words[0])).select("ref")
        else:
            hits = index.where(F.col("token") == words[0]).select("ref", "column", "pos")
            for step, word in enumerate(words[1:], 1):
                after = index.where(F.col("token") == word).select("ref", "column", (F.col("pos") - step).alias("pos"))
                hits = hits.join(after, ["ref", "column", "pos"], "left_semi")
            hits = hits.select("ref")
        hits = hits.distinct().withColumn("term", F.lit(at))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return index.select("ref").limit(0)
    return found.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("ref")


def grep(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose bytes hold the pattern."""
    return df.where(F.contains(F.col(column).cast("binary"), F.lit(pattern.encode())))


def extracted(df: DataFrame, column: str, pattern: str, name: str) -> DataFrame:
    """df and one row per match of group 1, with its place from 0."""
    return df.select("*", F.posexplode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))).alias("pos", name))


INCLUDE = r'(?m)^[ \t]*#[ \t]*include[ \t]*["<]([^">\n]+)'
