import struct

import pytest

from lodestone.sources import trace


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def text(s):
    return varint(len(s.encode())) + s.encode()


def record(kind, ts, *parts):
    return bytes([kind]) + varint(ts) + b"".join(text(p) if isinstance(p, str) else p for p in parts)


def u(n):
    return struct.pack("<I", n)


START = b"\0" * 4 + u(49) + b"\xff" * 5
SECOND = 10_000_000


def test_fixed_cases():
    assert trace.Reader(b"\xf1\x24").v() == 4721 and trace.Reader(b"\x26").v() == 38
    assert trace.Reader(b"\x03abc").s() == "abc"
    assert trace.next_plausible(b"\xff\xff\x80\x02\x10", 0) == 3


def whole():
    return (
        START + record(38, 1, u(1), "Host one") + record(2, SECOND, u(1), u(7), "A.cpp", "", b"\x01") + record(26, 2 * SECOND, varint(4), varint(1), varint(0))
        + record(3, 3 * SECOND, u(7), u(0)) + varint(5) * 5 + varint(1) + b"\0" + text("log") + record(3, 4 * SECOND, u(8), u(2)) + varint(0) * 6
        + record(21, 0, u(1), "noise") + record(20, 3661 * SECOND, u(1), u(1), "bad thing", b"\0", "") + record(13, 3662 * SECOND, u(1), varint(1), "Total", "9") + record(15, 3663 * SECOND, u(1))
    )


def test_lines(spark):
    df = spark.createDataFrame([("/t/a.uba", bytearray(whole())), ("/t/empty.uba", bytearray(START)), ("/t/short", bytearray(b"x")), ("/t/null", None)], "path string, content binary")
    rows = trace.lines(trace.decode(df)).orderBy("path", "at", "n").collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"], []).append(r["line"])
    assert set(got) == {"/t/a.uba", "/t/empty.uba"} and len(got["/t/empty.uba"]) == 5 and "version=49" in got["/t/a.uba"][1]
    assert got["/t/a.uba"][4:] == [
        "[00:00:00.000] SESSION   Host one", "[00:00:01.000] COMPILE   #7     A.cpp", "[00:00:02.000] PROGRESS [" + "█" * 6 + "░" * 18 + "] 1/4 25%",
        "[00:00:03.000] DONE      #7     A.cpp → OK", "[00:00:04.000] FAILED    #8     process #8 → exit=2", "[01:01:01.000] ERROR    bad thing",
        "[01:01:02.000] ── BUILD SUMMARY ──", " " * 15 + "Total".ljust(24) + " 9", "[01:01:03.000] DISCONNECT",
    ]


@pytest.mark.parametrize("cut", range(8, 160, 7))
def test_cut_and_noisy_files_end(cut):
    list(trace.records(whole()[:cut]))
    list(trace.records(whole()[:cut] + bytes(range(256)) * 8 + whole()))
