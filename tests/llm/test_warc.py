import hashlib
import random
import time

import pytest

from tamarack.llm import warc
from tamarack.session import fresh_path

PAGES = "page_id long, url string, html string, n int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], PAGES).repartition(3)


ROWS = [
    (4, "http://a/x", "A" * 100), (2, "http://a/y", "A" * 100), (9, None, "A" * 100), (1, "u v\r\n", "B" * 99), (3, "u", "B" * 99),
    (5, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", "é" * 50), (10, "u", "WARC/1.1\r\n\r\n" * 20),
    (11, "u", "\x00\r\n\r\n" * 60), (2, "http://a/y", "A" * 100),
]


def test_resolve_and_round_trip(spark):
    path = fresh_path(spark, "warc-test")
    resolved = warc.resolve_revisits(pages(spark, ROWS))
    warc.write_archives(resolved, path)
    back = warc.read_archives(spark, path).collect()
    assert len(back) == len(ROWS) and not any(r.gap for r in back)
    firsts = {"A" * 100: 2, "é" * 50: 7}
    want = []
    for i, _, html in ROWS:
        first = firsts.get(html, i)
        payload = (html or "").encode()
        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), None if i == first else first,
                     payload if i == first else b""))
    got = []
    for r in back:
        h = r.headers
        to = h.get("X-Refers-To-Page-ID")
        assert (h["WARC-Type"] == "revisit") == (to is not None) == ("WARC-Refers-To" in h)
        page = h.get("X-Page-ID")
        got.append((None if page is None else int(page), int(h["X-Payload-Length"]),
                    h["WARC-Payload-Digest"].removeprefix("sha256:"), None if to is None else int(to), bytes(r.payload)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_pages(spark):
    path = fresh_path(spark, "warc-none")
    warc.write_archives(warc.resolve_revisits(pages(spark, [])), path)
    assert warc.read_archives(spark, path).count() == 0


def record(i, html, plain=False):
    payload = html.encode()
    row = {"page_id": i, "url": f"http://h/{i}", "payload": payload, "payload_bytes": len(payload), "refers_to": None,
           "payload_digest": hashlib.sha256(payload).hexdigest(), "record_type": "response"}
    raw = warc.record(row, "2024-01-01T00:00:00Z")
    return raw if plain else warc.member(raw)


def found(data):
    ids, gaps, at = [], [], 0
    for offset, length, gap, headers, payload in warc.salvage(data):
        assert offset >= at
        at = offset
        if gap:
            gaps.append((offset, length))
        else:
            ids.append(int(headers["X-Page-ID"]))
            assert headers["WARC-Payload-Digest"] == f"sha256:{hashlib.sha256(payload).hexdigest()}"
    return ids, gaps


@pytest.mark.parametrize("plain", [False, True])
def test_salvage(plain):
    rng = random.Random(3)
    units = [record(i, "".join(rng.choices("abcdef <>", k=400)), plain) for i in range(6)]
    whole = b"".join(units)
    assert found(whole) == (list(range(6)), [])
    assert found(b"") == ([], [])
    begin, size = len(units[0] + units[1]), len(units[2])
    # a damaged byte, a lost tail, a lost head, noise between, noise at the end
    broken = bytearray(whole)
    broken[begin + size - 60] ^= 0x55
    assert found(bytes(broken)) == ([0, 1, 3, 4, 5], [(begin, size)])
    assert found(b"".join(units[:2]) + units[2][:-30] + b"".join(units[3:])) == ([0, 1, 3, 4, 5], [(begin, size - 30)])
    assert found(whole[10:]) == ([1, 2, 3, 4, 5], [(0, len(units[0]) - 10)])
    assert found(units[0] + b"noise WARC/1.1 \x1f\x8b\x08 noise" + units[1])[0] == [0, 1]
    assert found(whole + b"xyz") == (list(range(6)), [(len(whole), 3)])
    assert found(whole[:-5])[0] == [0, 1, 2, 3, 4]
    assert found(units[0] + b"\0\0\0" + units[1]) == ([0, 1], [])
    assert found(b"only noise") == ([], [(0, 10)])


def test_salvage_inside_members():
    rng = random.Random(5)
    plain = [record(i, "".join(rng.choices("abcdef <>", k=3000)), True) for i in range(6)]
    member = warc.member(b"".join(plain))
    assert found(member) == (list(range(6)), [])
    # one bad record in an intact member: the gap names its unpacked bytes
    bad = plain[2].replace(b"WARC-Type: ", b"WARC-Type ")
    rows = list(warc.salvage(warc.member(b"".join([*plain[:2], bad, *plain[3:]])) + record(9, "z" * 300)))
    assert [int(r[3]["X-Page-ID"]) for r in rows if r[3]] == [0, 1, 3, 4, 5, 9]
    (gap,) = [r for r in rows if r[2]]
    start = len(plain[0] + plain[1])
    assert f"bytes {start} to {start + len(bad)} " in gap[2]
    # a lost tail and a damaged byte: what came before the fault is kept, later members are found
    cut = member[: len(member) * 2 // 3]
    ids, gaps = found(cut + record(9, "z" * 300))
    assert ids[:3] == [0, 1, 2] and ids[-1] == 9 and gaps == [(0, len(cut))]
    broken = bytearray(member)
    broken[len(member) // 2] ^= 0x55
    ids, gaps = found(bytes(broken) + record(9, "z" * 300))
    assert ids[:2] == [0, 1] and ids[-1] == 9 and gaps == [(0, len(member))]
    # a whole member that holds no record at all
    noise = warc.member(b"no record")
    assert found(noise + record(1, "a" * 200)) == ([1], [(0, len(noise))])


def test_reading_time_grows_with_the_size():
    rng = random.Random(6)
    units = [record(i, "".join(rng.choices("abcdefgh", k=2000))) for i in range(1500)]
    small, large = b"".join(units), b"".join(units * 4)

    def seconds(data):
        start = time.process_time()
        assert sum(1 for _ in warc.salvage(data)) == (1500 if data is small else 6000)
        return time.process_time() - start

    assert seconds(large) < 8 * max(min(seconds(small), seconds(small)), 0.02)


def test_long_lists_of_first_holders_are_shuffled(spark, monkeypatch):
    short = sorted(map(repr, warc.resolve_revisits(pages(spark, ROWS)).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, warc.resolve_revisits(pages(spark, ROWS)).collect())) == short


def test_mixed_and_bad_headers():
    good, bad = record(1, "x" * 200, True), record(2, "y" * 200, True)
    assert found(record(0, "z" * 200) + good)[0] == [0, 1]
    for damage in (lambda b: b.replace(b"Content-Length: ", b"Content-Length: 9"),
                   lambda b: b.replace(b"Content-Length: ", b"Content-Length: x"),
                   lambda b: b.replace(b"WARC-Type: ", b"WARC-Type "), lambda b: b.replace(b"yyy", b"yzy", 1)):
        ids, gaps = found(damage(bad) + good)
        assert ids == [1] and gaps == [(0, len(damage(bad)))]


def test_gaps_reach_the_table(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(record(1, "a" * 300) + b"damage" + record(2, "b" * 300))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    gaps = [r for r in rows if r.gap]
    assert len(rows) == 3 and len(gaps) == 1 and gaps[0].length == 6 and gaps[0].payload is None
