"""Audits of a corpus: versions, schemas by file, lines, lift, imports, exposure, quarantine."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tamarack.functions.imports import imports_of
from tamarack.operators import audit
from tamarack.operators.versions import corpus_diff
from tamarack.sources import (
    chunk_report,
    file_census,
    scan_chunks,
    schema_conflicts,
    schema_groups,
    usable_paths,
)


def test_corpus_diff_against_plain_comparison(spark):
    rnd = random.Random(1)
    texts = ["", "a", "aa", "aaa", "é🙂b", None, "hello\nworld", "hello\nthere world", "xhello\nworld", "hello\nworld!"]
    old = [(i, rnd.choice(texts)) for i in range(200)] + [(300, "gone"), (400, "x"), (400, "x"), (None, "a")]
    new = [(i, rnd.choice(texts)) for i in range(200)] + [(500, "fresh"), (400, "x"), (None, "ab")]
    schema = "k long, t string, key string, change string, own string"
    frames = [spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema).repartition(3) for rows in (old, new)]
    found = {r.key: r for r in corpus_diff(*frames, "k", "t").collect()}
    before, after = defaultdict(list), defaultdict(list)
    for rows, side in ((old, before), (new, after)):
        for k, t in rows:
            side[k].append(t or "")
    assert set(found) == set(before) | set(after)
    for k, r in found.items():
        a, b = before.get(k), after.get(k)
        if a is None or b is None or len(a) + len(b) > 2:
            assert r.change == ("new" if a is None else "missing" if b is None else "repeated")
            continue
        (a,), (b,) = a, b
        kind = "unchanged" if a == b else "prefix_added" if b.endswith(a) else "suffix_added" if b.startswith(a) else "rewritten"
        assert (r.change, r.old_chars, r.new_chars) == (kind, len(a), len(b))
        if kind == "unchanged":
            assert r.common_prefix is None
            continue
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        most = min(len(a), len(b)) - p
        s = next((i for i in range(most) if a[-1 - i] != b[-1 - i]), most)
        assert (r.common_prefix, r.common_suffix) == (p, s), (a, b)


def test_unchanged_texts_are_not_shuffled(spark):
    old = spark.range(100).select("id", F.repeat(F.lit("text "), 50).alias("t"))
    plan = corpus_diff(old, old, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_file_census(spark, tmp_path):
    pq.write_table(pa.table({"content": ["a"], "n": [1]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"content": ["b", "c"], "n": [1, 2]}), tmp_path / "b.parquet")
    pq.write_table(pa.table({"n": ["x"], "text": ["t"]}), tmp_path / "c.parquet")
    pq.write_table(pa.table({"id": [1]}), tmp_path / "d.parquet")
    (tmp_path / "e.parquet").write_bytes(b"PAR1 broken")
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as out, pa.ipc.new_file(out, pa.schema([("src", pa.string())])):
        pass
    census = file_census(spark, str(tmp_path))
    rows = {r.file_name: r for r in census.collect()}
    assert {n: (r.kind, r.n_rows, r.content_column, r.usable) for n, r in rows.items()} == {
        "a.parquet": ("parquet", 1, "content", True), "b.parquet": ("parquet", 2, "content", True),
        "c.parquet": ("parquet", 1, "text", True), "d.parquet": ("parquet", 1, "id", False),
        "e.parquet": ("unreadable", None, None, False), "f.arrow": ("arrow file", None, "src", True),
    }
    assert rows["a.parquet"].schema_digest == rows["b.parquet"].schema_digest != rows["c.parquet"].schema_digest
    groups = {r.column_names: r.n_files for r in schema_groups(census).collect()}
    assert groups == {"content,n": 2, "n,text": 1, "id": 1, "src": 1, "": 1}
    assert {(r.name, r.type, r.n_files) for r in schema_conflicts(census).collect()} == {("n", "int64", 2), ("n", "string", 1)}
    assert usable_paths(census).count() == 4


def test_line_frequency(spark):
    rows = [("# licence  \nx", f"s{i % 3}") for i in range(30)] + [("own\n", "s1"), (None, "s1"), ("", None), ("\nx", "a")]
    rows += [("rare", None), ("rare\n", None), ("rare \ny", "s1")]
    df = spark.createDataFrame(rows, "text string, source string").withColumn("line", F.lit("clash"))
    found = {r.line: (r.n_docs, r.n_groups, r.about_groups) for r in audit.line_frequency(df, "text", "source", 3).collect()}
    assert found == {"# licence": (30, 3, 3), "rare": (3, 2, 2)}


def test_rare_name_lift(spark):
    left, right = {"a": 30, "b": 5, "c": 1}, {"a": 40, "c": 900, "d": 7}
    frames = [spark.createDataFrame([*x.items(), (None, 3)], "name string, n long") for x in (left, right)]
    found = {r.name: r for r in audit.rare_name_lift(*frames, prior=50.0).collect()}
    n, m = sum(left.values()), sum(right.values())
    for name in "abcd":
        y, z = left.get(name, 0), right.get(name, 0)
        a = 50 * (y + z) / (n + m)
        odds = math.log((y + a) / (n + 50 - y - a)) - math.log((z + a) / (m + 50 - z - a))
        assert found[name].log_odds == pytest.approx(odds)
        assert found[name].z_score == pytest.approx(odds / math.sqrt(1 / (y + a) + 1 / (z + a)))
    assert found["b"].z_score > 1 > found["c"].z_score and len(found) == 4


def test_exposure_by_label(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(2000):
        source = f"s{i % 4}"
        bad = rnd.random() < 0.1 + 0.2 * (i % 4)
        hit = rnd.random() < 0.05 + 0.15 * (i % 4)  # depends on the source alone
        rows.append((source, int(bad), None if i % 10 == 0 else 0, hit if i % 50 else None))
    df = spark.createDataFrame(rows, "source string, bad int, none int, hit boolean")
    found = {r.label: r for r in audit.exposure_by_label(df, F.col("hit"), ["bad", "none"], ["source"]).collect()}
    r = s = 0.0
    cells = Counter((source, bad, bool(hit)) for source, bad, _, hit in rows)
    for source in {row[0] for row in rows}:
        a, b, c, d = (cells[source, x, y] for x, y in ((1, True), (1, False), (0, True), (0, False)))
        r, s = r + a * d / (a + b + c + d), s + b * c / (a + b + c + d)
    bad = found["bad"]
    assert bad.odds_ratio == pytest.approx(r / s) and bad.low < 1 < bad.high
    crude = bad.labelled_hits / (bad.n_labelled - bad.labelled_hits) * (bad.n_others - bad.other_hits) / bad.other_hits
    assert crude > 1.4 * bad.odds_ratio
    assert found["none"].odds_ratio is None and found["none"].n_labelled == 0 and found["none"].n_others == 1800


def test_quarantine_is_published_at_once(spark, tmp_path):
    path = str(tmp_path / "corpus")
    df = spark.createDataFrame([(1, "zz_marker"), (2, "fine"), (3, None), (4, "zz_marker, short")], "id long, text string")
    reasons = {"marker": F.contains("text", F.lit("zz_marker")), "short": F.length("text") > 10}
    with pytest.raises(Exception):
        audit.read_published(spark, path, "clean")
    audit.publish_quarantine(df, reasons, path, "v1")

    def state():
        bad = {r.id: r.reasons for r in audit.read_published(spark, path, "quarantine").collect()}
        return {r.id for r in audit.read_published(spark, path, "clean").collect()}, bad

    first = ({2, 3}, {1: ["marker"], 4: ["marker", "short"]})
    assert state() == first
    # a write that dies half-way leaves what is published; repeated, it takes over
    boom = F.when(F.col("id") == 4, F.raise_error(F.lit("killed"))).otherwise(F.lit(True))
    with pytest.raises(Exception, match="killed"):
        audit.publish_quarantine(df, {"boom": boom}, path, "v2")
    assert state() == first
    audit.publish_quarantine(df, {"null": F.col("text").isNull()}, path, "v2")
    assert state() == ({1, 2, 4}, {3: ["null"]})


SOURCE = '''\
#!/usr/bin/env python
"""import docstring
import still_docstring"""
import os, sys as system  # import comment
import numpy.linalg as la; import json
from . import sibling
from .. pkg . deep import (one as uno,  # import two
    two,
)
from __future__ import annotations
x = "import inside" + 'from a import b'
if x: import late
try:
    import a\\
        .b as c
except ImportError: pass
values = [1,
import_not, "import no"]
from star import *
important = 3
r = rb\'import raw\'
yield_from = from_x
'''


def test_imports_of_a_source(spark):
    assert list(imports_of(SOURCE)) == [
        (4, "os", None, None), (4, "sys", None, "system"), (5, "numpy.linalg", None, "la"), (5, "json", None, None),
        (6, ".", "sibling", None), (7, "..pkg.deep", "one", "uno"), (7, "..pkg.deep", "two", None),
        (10, "__future__", "annotations", None), (12, "late", None, None), (14, "a.b", None, "c"), (19, "star", "*", None),
    ]
    for odd in ("", "import", "from", "from x", "import ,", "import (", "'import x", '"""import x', "don't import\nimport y", "from . import"):
        assert len(list(imports_of(odd))) == (1 if odd.endswith("y") else 0)
    rows = spark.createDataFrame([(1, SOURCE), (2, None), (3, "no such word"), (4, "import x")], "id long, text string")
    found = audit.import_inventory(rows, "id", "text").collect()
    assert Counter(r.id for r in found) == {1: 11, 4: 1}


def test_chunks_are_read_if_their_write_ended(spark, tmp_path):
    for k, n in enumerate((3, 4, 5)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / f"chunk_{k}"))
    (tmp_path / "chunk_1" / "_SUCCESS").unlink()
    report = [(r.chunk, r.status, r.n_files) for r in chunk_report(spark, str(tmp_path)).collect()]
    assert report == [("chunk_0", "read", 1), ("chunk_1", "skipped", 1), ("chunk_2", "read", 1)]
    rows = scan_chunks(spark, str(tmp_path), "id long").groupBy("chunk").count().collect()
    assert {r.chunk: r["count"] for r in rows} == {"chunk_0": 3, "chunk_2": 5}
