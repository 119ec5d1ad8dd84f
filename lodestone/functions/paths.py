"""Path and type expressions, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(path: Column) -> Column:
    """Forward slashes, none doubled, none at the end; drive letters lower-cased."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"(?<!:)/{2,}", "/")
    p = F.regexp_replace(p, r"^([A-Za-z]):/+", "$1:/")
    p = F.when(p.rlike("^[A-Z]:/"), F.concat(F.lower(p.substr(1, 1)), p.substr(F.lit(2), F.length(p)))).otherwise(p)
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def key(path: Column) -> Column:
    """A path as a key: forward slashes, none at the end but of a root."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.regexp_replace(p, "^(.{3}.*?)/+$", "$1")


def cache_name(path: Column) -> Column:
    """A path as a file name: slashes and colons as underscores."""
    return F.regexp_replace(normalised(path), r"[\\/:]", "_")


def index_name(root: Column) -> Column:
    """The name of a project's index: its folder's and the first digits of the path's digest."""
    name = filename(root)
    return F.concat_ws("_", F.when(name == "", "Root").otherwise(name), F.substring(F.sha2(root, 256), 1, 16))


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(filename(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), r"\.[^.]*$", "")


def prefixes(path: Column) -> Column:
    """All directory prefixes of a path and itself, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def longest_prefix(files: DataFrame, roots: DataFrame, path: str = "path", default: str | None = "_Global") -> DataFrame:
    """files with `root` and `name` of the deepest root (root, name) that holds them; an equi-join over prefixes, no theta join."""
    keys = files.select(path).distinct().withColumn("root", F.explode(prefixes(F.col(path))))
    best = keys.join(roots, "root").groupBy(path).agg(F.max_by(F.struct("root", "name"), F.struct(F.length("root"), F.col("name"))).alias("b")).select(path, "b.*")
    out = files.join(best, path, "left")
    return out if default is None else out.withColumn("name", F.coalesce("name", F.lit(default)))


def in_directories(path: Column, names: list[str]) -> Column:
    """Does one of the (lower-cased) directory names occur in the path?"""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, names)))


def category(path: Column) -> Column:
    """source, shader, config, content or other, by the directory under the module."""
    p = F.lower(path)
    ladder = [("/source/", "source"), ("/shaders/", "shader"), ("/config/", "config"), ("/content/", "content"), ("/programs/", "program")]
    out = F.when(p.contains(ladder[0][0]), ladder[0][1])
    for mark, name in ladder[1:]:
        out = out.when(p.contains(mark), name)
    return out.otherwise("other")


def include_path(path: Column, module_root: Column) -> Column:
    """How a header is included: relative to its module, less a leading Public, Classes, Internal or Private."""
    relative = F.when(path.startswith(F.concat(module_root, F.lit("/"))), path.substr(F.length(module_root) + 2, F.length(path))).otherwise(filename(path))
    return F.regexp_replace(relative, "^(Public|Classes|Interfaces|Internal|Private)/", "")


def clean_type(text: Column) -> Column:
    """A C++ type without qualifiers, export macros, references; smart pointers unwrapped."""
    t = F.regexp_replace(text, r"\b(const|volatile|mutable|static|virtual|inline|constexpr|class|struct|enum|typename|FORCEINLINE|[A-Z0-9]+_API|UPROPERTY|UFUNCTION|UPARAM)\b(\s*\([^)]*\))?", " ")
    t = F.regexp_replace(t, r"[&*]", " ")
    t = F.regexp_replace(t, r"\b(TObjectPtr|TSharedPtr|TSharedRef|TWeakPtr|TWeakObjectPtr|TUniquePtr|TSoftObjectPtr|TSubclassOf|TSoftClassPtr|TScriptInterface)\s*<\s*([^<>]*?)\s*(,[^<>]*)?>", "$2")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def pointee(text: Column, depth: int = 8) -> Column:
    """The type inside the outermost brackets, and again up to `depth` times; without const, * and &."""
    for _ in range(depth):
        text = F.when(text.rlike("<.*>"), F.regexp_extract(text, "<(.*)>", 1)).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^(const )+", ""), r"[*&\s]+$", ""))


def element_type(text: Column) -> Column:
    """What a container holds: the element, of a map the value."""
    inner = F.regexp_extract(text, r"^\s*(?:TArray|TSet|TQueue|TSortedMap|TMap|TMultiMap)\s*<(.*)>\s*$", 1)
    value = F.regexp_extract(text, r"^\s*(?:TMap|TMultiMap|TSortedMap)\s*<[^,<>]*,(.*)>\s*$", 1)
    return F.trim(F.when(value != "", value).when(inner != "", F.regexp_replace(inner, r",[^<>]*$", "")).otherwise(text))


def matches_all(column: Column, words: str) -> Column:
    """Every white-space separated token occurs, ASCII case aside; % and _ are wildcards. No token: nothing matches."""
    out: Column | None = None
    for w in words.split():
        one = column.ilike("%" + w.replace("\\", "\\\\") + "%")
        out = one if out is None else out & one
    return F.lit(False) if out is None else out
