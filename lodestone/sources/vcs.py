"""Changed files, commits and revisions of version control tools, parsed from their text output. Null and malformed lines give no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Actions and their status letters.
ACTIONS = {"add": "A", "branch": "A", "move/add": "A", "import": "A", "delete": "D", "move/delete": "D", "purge": "D", "edit": "M", "integrate": "M"}


def git_diff(lines: DataFrame, column: str = "value") -> DataFrame:
    """(status, path) of `diff --name-status`; of a rename the new path."""
    parts = F.split(F.col(column), "\t")
    return lines.where(F.trim(column) != "").select(F.substring(F.element_at(parts, 1), 1, 1).alias("status"), F.element_at(parts, -1).alias("path"))


def git_status(lines: DataFrame, column: str = "value", submodule: bool = False) -> DataFrame:
    """(status, path) of `status --porcelain`; submodules skip untracked files."""
    text = F.col(column)
    rows = lines.where(F.length(text) > 3).select(F.trim(F.substring(text, 1, 2)).alias("status"), F.regexp_replace(F.substring_index(text.substr(F.lit(4), F.length(text)), " -> ", -1), '^"|"$', "").alias("path"))
    return rows.where(F.col("status") != "??") if submodule else rows


def git_unpushed(lines: DataFrame, root: str, column: str = "value") -> DataFrame:
    """(path, status) of the names of files in commits that are not pushed, each once."""
    name = F.regexp_replace(F.col(column), '^"|"$', "")
    return lines.where(F.trim(column) != "").select(F.concat(F.lit(root.rstrip("/") + "/"), name).alias("path")).distinct().select("path", F.lit("Unpushed").alias("status"))


def git_between(lines: DataFrame, root: str, column: str = "value") -> DataFrame:
    """(path) of `diff --name-only` between two revisions."""
    return lines.where(F.trim(column) != "").select(F.concat(F.lit(root.rstrip("/") + "/"), F.col(column)).alias("path"))


def reference(hash_: Column) -> Column:
    """A stored revision as the tool takes it: without its provider."""
    return F.regexp_replace(hash_, "^(git|svn|p4):", "")


def svn_summary(lines: DataFrame, column: str = "value") -> DataFrame:
    """(status, path) of `diff --summarize`: eight status columns, then the path."""
    text = F.col(column)
    return lines.where(F.length(text) > 8).select(F.substring(text, 1, 1).alias("status"), F.trim(text.substr(F.lit(9), F.length(text))).alias("path"))


def p4_fstat(blocks: DataFrame, column: str = "value") -> DataFrame:
    """(status, path) of fstat blocks, one block a row."""
    field = lambda n: F.regexp_extract(F.col(column), rf"(?m)^\.\.\. {n} (.*)$", 1)
    action = F.coalesce(F.nullif(field("headAction"), F.lit("")), F.nullif(field("action"), F.lit("")))
    return blocks.select(status_letter(action).alias("status"), field("clientFile").alias("path")).where("path <> ''")


def status_letter(action: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.coalesce(F.element_at(table, action), F.lit("M"))


def merged(changes: DataFrame) -> DataFrame:
    """(path, status) of (provider_rank, path, status): the first provider wins."""
    return changes.groupBy("path").agg(F.min_by("status", "provider_rank").alias("status"))


def age(seconds: Column) -> Column:
    """minutes, hours or days ago."""
    n = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds < 3600, F.concat(n(60), F.lit(" minutes ago"))).when(seconds < 86400, F.concat(n(3600), F.lit(" hours ago"))).otherwise(F.concat(n(86400), F.lit(" days ago")))


def git_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(hash, message, author, date, vcs) of log lines whose four fields a unit separator (1F) parts."""
    f = F.split(F.col(column), "\u001f")
    return lines.where(F.size(f) >= 4).select(f[0].alias("hash"), f[1].alias("message"), f[2].alias("author"), f[3].alias("date"), F.lit("git").alias("vcs"))


def p4_log(blocks: DataFrame, now: Column, column: str = "value") -> DataFrame:
    """The same of tagged change blocks, one a row; now is in seconds."""
    field = lambda n: F.nullif(F.regexp_extract(F.col(column), rf"(?m)^\.\.\. {n}\s+(.+)$", 1), F.lit(""))
    date = age(now - field("time").cast("long"))
    return blocks.where(field("change").isNotNull()).select(
        field("change").alias("hash"), F.coalesce(F.trim(field("desc")), F.lit("(no description)")).alias("message"), F.coalesce(field("user"), F.lit("")).alias("author"), F.coalesce(date, F.lit("")).alias("date"), F.lit("p4").alias("vcs")
    )


def svn_log(texts: DataFrame, now: Column, column: str = "value") -> DataFrame:
    """The same of the XML log, whole texts; a date that cannot be read stays as it is."""
    entry = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit("(?s)<logentry(.*?)</logentry>"), F.lit(1))).alias("e"))
    part = lambda n: F.regexp_extract("e", f"(?s)<{n}>([^<]*)</{n}>", 1)
    rev, has_message = F.regexp_extract("e", r'revision="(\d+)"', 1), F.col("e").rlike("(?s)<msg>[^<]*</msg>")
    second = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract("e", r"<date>(\d+-\d+-\d+T\d+:\d+:\d+)", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    rows = entry.where(rev != "").select(F.concat(F.lit("r"), rev).alias("hash"), F.when(has_message, part("msg")).otherwise("(no message)").alias("message"), part("author").alias("author"), F.coalesce(age(now - second), part("date")).alias("date"))
    return rows.withColumn("vcs", F.lit("svn"))


def shown(commits: DataFrame) -> DataFrame:
    return commits.withColumn("display", F.format_string("%s %s (%s)", "hash", "message", "date"))


def newest(commits: DataFrame, order: Column, limit: int, author: str | None = None) -> DataFrame:
    """The first limit commits by order (descending), of one author if named."""
    rows = commits if author is None else commits.where(F.col("author") == author)
    return rows.orderBy(order.desc(), "hash").limit(limit)


def commit_files(lines: DataFrame, column: str = "value") -> DataFrame:
    """(type, path, name, old_hash, new_hash) of raw show lines; submodules first, then by path."""
    pattern = r"^:\d+ (\d+) ([0-9a-f]+) ([0-9a-f]+) [A-Z]\d*\s+(.+)$"
    part = lambda i: F.regexp_extract(F.col(column), pattern, i)
    kind = F.when(part(1) == "160000", "submodule").otherwise("file")
    rows = lines.where(F.col(column).rlike(pattern)).select(kind.alias("type"), part(4).alias("path"), part(2).alias("old_hash"), part(3).alias("new_hash"))
    name = F.when(F.col("type") == "submodule", F.col("path")).otherwise(F.substring_index("path", "/", -1))
    return rows.select("type", "path", name.alias("name"), "old_hash", "new_hash").orderBy(F.desc("type"), "path")


def submodule_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, rel_path, full_rel_path): the changed files (path of the submodule, rel_path) of commit_files' submodules."""
    return files.where("type = 'submodule'").select("path").join(changed, "path").select("path", "rel_path", F.concat_ws("/", "path", "rel_path").alias("full_rel_path"))


def revision(revisions: DataFrame) -> DataFrame:
    """One row: the revision of the first provider that has one, of (provider_rank, revision)."""
    return revisions.where("revision is not null and revision <> ''").agg(F.min_by("revision", "provider_rank").alias("revision"))


def build_fingerprint(versions: DataFrame) -> DataFrame:
    """(fingerprint) of build version records (MajorVersion, MinorVersion, PatchVersion, BranchName); missing numbers are 0, a missing branch is Unknown."""
    return versions.select(F.format_string("ue:%d.%d.%d+%s", *[F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("MajorVersion", "MinorVersion", "PatchVersion")], F.coalesce("BranchName", F.lit("Unknown"))).alias("fingerprint"))
