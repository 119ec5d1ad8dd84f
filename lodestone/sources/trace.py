"""Binary build traces: records by a table of field layouts, and the lines they read as.

A file is decoded in one Python call that yields its records in blocks; the names of exited processes are joined in and lines are formatted by Spark expressions.
Defined cases: null or fewer than 8 bytes, no records and no lines; bytes that are no record are skipped, 512 of them in a row end the file; a record of time 0 after
real time is noise and is dropped; a file without records says so in one line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format: record kinds, and the fields after kind and time. u: 4 bytes, v: 7-bit number, s: counted text, b: byte, p: counted pairs of texts, x: 4 bytes unread.
SESSION_ADDED, SESSION_UPDATE, ADDED, EXITED, SUMMARY, SESSION_SUMMARY, DISCONNECT, STATUS, NOTIFY, PROGRESS, SCHEDULER, INFO = 0, 1, 2, 3, 9, 13, 15, 20, 21, 26, 36, 38
LAYOUTS = {
    SESSION_ADDED: "uuss", SESSION_UPDATE: "uvvvvvvx", ADDED: "uussb", EXITED: "uu", 4: "u", SUMMARY: "up", 12: "us", SESSION_SUMMARY: "up", 14: "us", DISCONNECT: "u",
    STATUS: "uusbs", NOTIFY: "us", PROGRESS: "vvv", 27: "us", 29: "us", 31: "uvv", 32: "uvvv", INFO: "us",
}
LAST_KIND, FREQUENCY = 38, 10_000_000
LONGEST_TEXT, MOST_PAIRS = 4096, 128
NOISE_LIMIT, SCAN, BLOB_SCAN, START_SCAN = 512, 512, 16384, 512
LATEST = 10_000_000_000_000
# Kinds that are read again from their second byte if a field fails; the others go on where reading stopped.
STRICT = {SESSION_ADDED, ADDED, EXITED, 4, SUMMARY, SESSION_SUMMARY, DISCONNECT, STATUS, NOTIFY, PROGRESS, 29, INFO}

SCHEMA = "path string, at long, kind string, ts long, pid long, code long, text string, total long, done long, pairs array<struct<name:string,value:string>>"
COLUMNS = ["path", "at", "kind", "ts", "pid", "code", "text", "total", "done", "pairs"]
BLOCK = 5000


class Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def u(self) -> int | None:
        if self.at + 4 > len(self.data):
            return None
        self.at += 4
        return int.from_bytes(self.data[self.at - 4 : self.at], "little")

    def b(self) -> int | None:
        if self.at >= len(self.data):
            return None
        self.at += 1
        return self.data[self.at - 1]

    def v(self) -> int | None:
        value = 0
        for shift in range(0, 70, 7):
            byte = self.b()
            if byte is None:
                return None
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value & (1 << 64) - 1
        return None

    def s(self) -> str | None:
        n = self.v()
        if n is None or n > LONGEST_TEXT or self.at + n > len(self.data):
            return None
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def p(self, most: int = MOST_PAIRS) -> list[tuple[str, str]] | None:
        """Pairs up to a missing one, which is noted by an empty entry at the end."""
        n = self.v()
        if n is None:
            return None
        out = []
        for _ in range(min(n, most)):
            pair = (self.s(), self.s())
            if None in pair:
                return [*out, ()]
            out.append(pair)
        return out

    def x(self) -> int | None:
        return self.u()

    def fields(self, layout: str, strict: bool = True) -> list | None:
        """Values of the fields; None where one is missing."""
        out, whole = [], True
        for code in layout:
            value = getattr(self, code)()
            out.append(value)
            whole = whole and value is not None and not (code == "p" and value[-1:] == [()])
            if strict and not whole:
                break
        return out if whole else None


def _named(text: str | None) -> bool:
    return text is not None and len(text) >= 4 and text.isascii()


# What the fields of a record that follows unread bytes must hold.
CREDIBLE: dict[int, tuple[str, Callable[..., bool]]] = {
    PROGRESS: ("vvv", lambda total, done, errors: total < 100_000 and done <= total and errors < 100_000),
    ADDED: ("uus", lambda session, pid, text: session < 1000 and pid < 100_000_000 and _named(text)),
    INFO: ("us", lambda session, text: session < 1000 and _named(text)),
    SESSION_SUMMARY: ("uv", lambda session, n: session < 1000 and n < 1000),
    STATUS: ("uus", lambda row, column, text: row < 65536 and column < 65536 and _named(text)),
}


def _credible(data: bytes, at: int, kinds: Iterable[int]) -> bool:
    if data[at] not in kinds:
        return False
    r = Reader(data, at + 1)
    layout, holds = CREDIBLE[data[at]]
    return r.v() is not None and (found := r.fields(layout)) is not None and holds(*found)


def next_credible(data: bytes, start: int) -> int:
    return next((i for i in range(start, min(len(data), start + BLOB_SCAN)) if _credible(data, i, CREDIBLE)), start + 1)


def next_plausible(data: bytes, start: int) -> int:
    """The next kind byte with a time of at most six bytes after it."""
    for i in range(start, min(len(data), start + SCAN)):
        if data[i] <= LAST_KIND:
            r = Reader(data[i + 1 : i + 7])
            time = r.v()
            if time is not None and time < LATEST:
                return i
    return start + 1


def _run_length(data: bytes, at: int) -> int:
    """How many records of well-known kinds, eight at most, follow one another here."""
    r, n = Reader(data, at), 0
    while n < 8 and (kind := r.b()) in (INFO, NOTIFY, SESSION_ADDED, SESSION_SUMMARY, ADDED, PROGRESS) and r.v() is not None:
        found = r.fields(LAYOUTS[kind])
        if found is None or (kind == ADDED and len(found[2].encode()) > 256):
            break
        n += 1
    return n


def first_record(data: bytes) -> int:
    places = range(8, min(len(data), START_SCAN))
    return next((i for i in places if _credible(data, i, (INFO,))), None) or next((i for i in places if _run_length(data, i) >= 3), 8)


def _after_exit(data: bytes, at: int) -> int:
    """The place after an exit's numbers and log lines; where they do not read as such, the next credible record."""
    r = Reader(data, at)
    numbers = r.fields("vvvvvv")
    if numbers is None or numbers[-1] > LONGEST_TEXT:
        return next_credible(data, at)
    for _ in range(numbers[-1]):
        if r.fields("bs") is None:
            return next_credible(data, at)
    return r.at


def _row(kind: int, f: list) -> tuple | None:
    """(kind, pid, code, text, total, done, pairs) of a record that reads as a line; None for the others."""
    if kind == INFO and f[1].isascii():
        return ("session", None, None, f[1], None, None, None)
    if kind == SESSION_ADDED and f[2] and f[2].isascii() and "'" not in f[2] and "  " not in f[2]:
        return ("connected", None, None, f[2], None, None, None)
    if kind == DISCONNECT:
        return ("disconnect", None, None, None, None, None, None)
    if kind == NOTIFY and f[1] and f[1].isascii():
        return ("notify", None, None, f[1], None, None, None)
    if kind == ADDED and f[1] < 10_000_000 and f[2] and f[2].isascii():
        return ("started", f[1], None, f[2], None, None, None)
    if kind == EXITED and f[0] < 10_000_000:
        return ("exited", f[0], f[1], None, None, None, None)
    if kind == PROGRESS and 0 < f[0] <= 100_000 and f[2] <= 10_000:
        return ("progress", None, f[2], None, f[0], min(f[1], 1 << 40), None)
    if kind == STATUS and f[2] and f[2].isascii():
        return ("status", None, f[3], f[2], None, None, None)
    return None


def records(data: bytes) -> Iterator[tuple]:
    """(at, kind, ts, pid, code, text, total, done, pairs), the file's version first."""
    yield (0, "version", 0, None, int.from_bytes(data[4:8], "little"), None, None, None, None)
    r, noise, latest = Reader(data, first_record(data)), 0, 0
    while r.at < len(data) and noise < NOISE_LIMIT:
        at, kind = r.at, r.b()
        if kind > LAST_KIND:
            noise += 1
            continue
        noise, time = 0, r.v()
        if time is None:
            return
        real, latest = not (time == 0 and latest > 1_000_000), max(latest, time)
        time = min(time, (1 << 63) - 1)
        if kind == SCHEDULER:
            r.at = next_plausible(data, at + 1)
            continue
        if kind == SESSION_SUMMARY:  # its pairs count as far as they go, whatever its time
            session, pairs = r.u(), None
            pairs = r.p() if session is not None else None
            if pairs is not None:
                yield (at, "summary", time, None, None, None, None, None, [q for q in pairs if q and q[0]])
            if pairs is None or pairs[-1:] == [()]:
                r.at = at + 1
            continue
        found = r.fields(LAYOUTS.get(kind, "u"), kind in STRICT)
        if found is None:
            r.at = at + 1 if kind in STRICT else next_plausible(data, at + 1) if kind == SESSION_UPDATE else r.at
            continue
        row = _row(kind, found) if real else None
        if row:
            yield (at, row[0], time, *row[1:])
        if kind == EXITED:
            r.at = _after_exit(data, r.at)


def decode(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files(path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                for row in records(content) if content is not None and len(content) >= 8 else ():
                    rows.append((path, *row))
                    if len(rows) >= BLOCK:
                        yield pd.DataFrame(rows, columns=COLUMNS).astype({c: "Int64" for c in ("pid", "code", "total", "done")})
                        rows = []
            yield pd.DataFrame(rows, columns=COLUMNS).astype({c: "Int64" for c in ("pid", "code", "total", "done")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def clock(ticks: Column) -> Column:
    ms = F.floor(ticks / (FREQUENCY // 1000))
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def padded(text: Column, n: int) -> Column:
    return F.when(F.length(text) < n, F.rpad(text, n, " ")).otherwise(text)


def bar(done: Column, total: Column, width: int = 24) -> Column:
    full = F.least(F.floor(done * width / total), F.lit(width)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def with_names(rows: DataFrame) -> DataFrame:
    """rows with `process`: of an exit the text of the last start of its process before it, in the same file. One window over starts and exits by process, in order of place."""
    ends = F.coalesce(F.col("kind").isin("started", "exited"), F.lit(False))
    before = Window.partitionBy("path", "pid").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    started = F.last(F.when(F.col("kind") == "started", F.col("text")), ignorenulls=True).over(before)
    named = rows.where(ends).withColumn("process", started).withColumn("process", F.when(F.col("kind") == "exited", F.col("process")))
    return named.unionByName(rows.where(~ends).withColumn("process", F.lit(None).cast(named.schema["process"].dataType)))


def lines(rows: DataFrame) -> DataFrame:
    """(path, at, n, line): the trace as text, ordered by at and n within a path. rows come from `decode` and are best written or checkpointed first: they are read three times."""
    c, stamp = F.col, F.concat(F.lit("["), clock(F.col("ts")), F.lit("] "))
    text = lambda *parts: F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    pid = padded(c("pid").cast("string"), 5)
    named = F.coalesce("process", F.concat(F.lit("process #"), c("pid")))
    rule = F.lit("─" * 54)
    percent = F.floor(c("done") * 100 / c("total")).cast("string")
    level = F.when(c("code") == 0, "ERROR  ").when(c("code") == 1, "WARN   ").otherwise("STATUS ")
    title = F.array(F.concat(F.lit("┌"), rule, F.lit("┐")), F.concat(F.lit("│  UBA Build Trace  │  version="), c("code"), F.lit("  │  "), padded(F.substring_index("path", "/", -1), 20), F.lit("│")), F.concat(F.lit("└"), rule, F.lit("┘")), F.lit(""))
    items = F.transform("pairs", lambda p: F.concat(F.lit(" " * 15), padded(p["name"], 24), F.lit(" "), p["value"]))
    kind = c("kind")
    out = (
        F.when(kind == "version", title).when(kind == "session", text(stamp, "SESSION   ", c("text"))).when(kind == "connected", text(stamp, "CONNECTED ", c("text"))).when(kind == "disconnect", text(stamp, "DISCONNECT"))
        .when(kind == "notify", text(stamp, "NOTIFY    ", c("text"))).when(kind == "summary", F.concat(text(stamp, "── BUILD SUMMARY ──"), items)).when(kind == "started", text(stamp, "COMPILE   #", pid, " ", c("text")))
        .when(kind == "exited", F.when(c("code") == 0, text(stamp, "DONE      #", pid, " ", named, " → OK")).otherwise(text(stamp, "FAILED    #", pid, " ", named, " → exit=", c("code").cast("string"))))
        .when(kind == "progress", text(stamp, "PROGRESS [", bar(c("done"), c("total")), "] ", c("done").cast("string"), "/", c("total").cast("string"), " ", percent, "%", F.when(c("code") > 0, F.concat(F.lit("  errors="), c("code"))).otherwise("")))
        .when(kind == "status", text(stamp, level, "  ", c("text")))
    )
    shown = with_names(rows).select("path", "at", F.posexplode(out).alias("n", "line"))
    silent = rows.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c = 1")
    note = silent.select("path", F.lit(1).cast("long").alias("at"), F.lit(0).alias("n"), F.lit("  (No parseable records found — the UBA format may differ from TraceVersion 49)").alias("line"))
    return shown.unionByName(note)
