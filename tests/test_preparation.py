"""Operators of data preparation on small tables: nulls, empty and long values, ties, repeats, clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.operators import copydiff, drift, heavy, rejects
from tracemill.streaming import compactor

RULE = {
    "1,2,0,v,0,-,x": None, "1,2,0,v,0,3,x": None, '1,2,0,v,0,3,"a, ""b"""': None, '"1","2","0","v","0","-","x"': None, "01,002,0,f,1,+5,x": None, "1,2,0,e,0,.5,x": None, "1,2,0,e,0,5.,x": None,
    "1,2,0,e,0,1e3,x": None, '1,2,0,e,0,1,"a\nb"': None, "18446744073709551615,1,18446744073709551615,v,0,1,x": None, f"{'0' * 60}1,1,1,v,0,{'9' * 60},x": None, "1,2,0,v,0,1, ": None, "1,2,0,v,0,1,é ": None,
    "": "columns", None: "columns", "1,2,0,v,0,1": "columns", "1,2,0,v,0,1,x,y": "columns", "1\t2\t0": "columns", "\r": "columns", ",1,2,0,v,0,1,x": "columns",
    '1,2,0,v,0,1,"x': "quoting", '1,2,0,v,0,1,"x"y': "quoting", '1,2,0,v,0,1,"x" ': "quoting", '1,2,0,v,0,1,a"b': "quoting", '1,"2,0,v,0,1,x': "quoting", '"': "quoting", '1,2,a"b,0': "quoting", '1,2,0,v,0,1,"a\\"b"': "quoting",
    "0,2,0,v,0,1,x": "value", "1,0,0,v,0,1,x": "value", "-1,2,0,v,0,1,x": "value", "1.0,2,0,v,0,1,x": "value", " 1,2,0,v,0,1,x": "value", "1,2,0,V,0,1,x": "value", "1,2,0,v,2,1,x": "value", "1,2,0,v,true,1,x": "value",
    "1,2,0,v,0,nan,x": "value", "1,2,0,v,0,inf,x": "value", "1,2,0,v,0,1e400,x": "value", "1,2,0,v,0,-1,x": "value", "1,2,0,v,0,1,": "value", '1,2,0,v,0,1,""': "value", "١,2,0,v,0,1,x": "value", "18446744073709551616,2,0,v,0,1,x": "value",
    "1,2,0,v,0,,x": "value", "1,2,0,v,0,1 ,x": "value", "1\x00,2,0,v,0,1,x": "value", "1,2,0,v,0,0x10,x": "value", f"1,2,0,v,0,1,{'y' * 100_000}": None, "1\n,2,0,v,0,1,x": "value",
}


def test_rejected_rows(spark):
    rows = [(i, raw, "clash") for i, raw in enumerate(RULE)] * 2
    random.Random(3).shuffle(rows)
    got = rejects.parse_delimited(spark.createDataFrame(rows, "row_id bigint, raw string, reason string").repartition(3)).collect()
    assert len(got) == 2 * len(RULE)
    texts = list(RULE)
    assert {texts[r.row_id]: r.reason for r in got} == RULE
    typed = {texts[r.row_id]: r for r in got if r.reason is None}
    row = typed[f"{'0' * 60}1,1,1,v,0,{'9' * 60},x"]
    assert (int(row.line_no), int(row.hits)) == (1, 2**63 - 1)
    assert typed['1,2,0,v,0,3,"a, ""b"""'].expression == 'a, "b"' and typed['1,2,0,e,0,1,"a\nb"'].expression == "a\nb" and typed["1,2,0,v,0,-,x"].hits is None
    assert rejects.parse_delimited(spark.createDataFrame([], "row_id bigint, raw string")).count() == 0


_FIELD = re.compile(r'"((?:[^"]|"")*)"(?=,|\Z)|([^",]*)(?=,|\Z)', re.S)
_HITS = re.compile(r"\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
_DIGITS = re.compile(r"[0-9]+")
def split_record(raw):
    """The unquoted fields of one record, or None if its quoting is broken."""
    out, at = [], 0
    while True:
        m = _FIELD.match(raw, at)
        if m is None:
            return None
        out.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        at = m.end()
        if at == len(raw):
            return out
        at += 1


def _number(text, least):
    if not _DIGITS.fullmatch(text):
        return None
    digits = text.lstrip("0") or "0"
    if len(digits) > 20 or not least <= int(digits) <= 2**64 - 1:
        return None
    return digits


def _hits(text):
    if text == "-":
        return True, None
    m = _HITS.fullmatch(text)
    if not m:
        return False, None
    if m[2] is None and "." not in m[1]:
        digits = m[1].lstrip("0") or "0"
        if len(digits) > 308 and float(digits) == float("inf"):
            return False, None
        return True, str(min(int(digits), (2**63 - 1))) if len(digits) < 20 else str((2**63 - 1))
    number = float(text)
    if number == float("inf"):
        return False, None
    return True, str(min(int(number), (2**63 - 1)))


def by_the_rule(raw):
    """(reason, typed values) of one record, character by character; the reason is None for a valid record."""
    if not raw:
        return "columns", None
    fields = split_record(raw)
    if fields is None:
        return "quoting", None
    if len(fields) != 7:
        return "columns", None
    line_no, line, block = _number(fields[0], 1), _number(fields[1], 1), _number(fields[2], 0)
    good, hits = _hits(fields[5])
    checks = (line_no is not None, line is not None, block is not None, fields[3] in ("v", "e", "f"),
              fields[4] in ("0", "1"), good, fields[6] != "")
    if not all(checks):
        return "value", None
    return None, (line_no, line, block, fields[3], fields[4] == "1", hits, fields[6])


def random_record(rng):
    numbers = ["1", "007", "0", "18446744073709551615", "18446744073709551616", "1e3", "+1", "1.0", " 1", "0x1", ""]
    fields = [rng.choice(numbers), rng.choice(numbers), rng.choice(numbers), rng.choice("vefV"), rng.choice(["0", "1", "2", "true"]),
              rng.choice(["-", "1.5", "1e3", ".5", "5.", "+4", "1e309", "9" * 400, "-1", "1 ", "nan", "", "07"]), rng.choice(["x", "", 'say "no"', "a, b", "a\nb", "é", " ", "-", "'", "\\N", "~"])]
    if rng.random() < 0.6:
        fields[:6] = ["3", "4", "0", "v", "1", rng.choice(["-", "12", "1e2"])]
    raw = ",".join('"' + f.replace('"', '""') + '"' if rng.random() < 0.2 else f for f in fields)
    for _ in range(rng.choice([0, 0, 1, 2])):
        at = rng.randrange(len(raw) + 1)
        raw = raw[:at] + rng.choice(['"', ",", "\n", "\r", "é", "\x00", "\x01", "~", "𝄞", " ", ""]) + raw[at + rng.randrange(2):]
    return raw


def test_rejected_rows_by_brute_force(spark):
    rng = random.Random(11)
    raws = [random_record(rng) for _ in range(20_000)] + ["".join(rng.choice('",\n~é1v') for _ in range(rng.randrange(20))) for _ in range(5_000)]
    got = rejects.parse_delimited(spark.createDataFrame(list(enumerate(raws)), "row_id bigint, raw string").repartition(3)).collect()
    assert len(got) == len(raws) and all(r.lenient is False for r in got if r.reason is None)
    for r in got:
        values = None if r.reason else tuple(str(r[c]) if c in ("line_no", "line", "block", "hits") and r[c] is not None else r[c] for c in rejects.FIELDS)
        assert (r.reason, values) == by_the_rule(raws[r.row_id]), raws[r.row_id]


def test_reasons_come_from_the_reject_tables(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "1,2,0,v,0,1,x,y"), (2, "1,2,0,v,0,1,x")], "row_id bigint, raw string")
    monkeypatch.setattr(rejects, "_JOIN", rejects._JOIN.replace("FROM reject_errors", "FROM reject_errors WHERE false"))
    with pytest.raises(Exception, match="neither loaded nor rejected"):
        list(rejects.parse_batches(rows.toArrow().to_batches()))


HITS = {"-": None, "0": "0", "007": "7", "+5": "5", ".5": "0", "5.": "5", "2.9": "2", "1e3": "1000", "+2.5E1": "25", "123456789012345678901e-3": "123456789012345680", "9007199254740993": "9007199254740993", "9223372036854774784.0": str(2**63 - 1024),
        "9223372036854775806": str(2**63 - 2), "9223372036854775807": str(2**63 - 1), "9223372036854775808": str(2**63 - 1), "18446744073709551616": str(2**63 - 1), "1e30": str(2**63 - 1), "9" * 60: str(2**63 - 1), "+" + "0" * 60 + "4": "4"}


def test_loaded_rows_keep_their_hits(spark, tmp_path):
    import duckdb

    from tracemill.plans import preparation

    rows = [(i, f"1,2,0,v,0,{hits},x") for i, hits in enumerate(HITS)] + [(98, "1,2,0,v,0,1e999,x"), (99, '1,2,0,v,1,"3","y"')]
    spark.createDataFrame(rows, "row_id bigint, raw string").coalesce(1).write.parquet(f"{tmp_path}/branch_rows.parquet")
    loaded = preparation.QUERIES["p1_branch_records"](spark, str(tmp_path))
    got = {r.row_id: r for r in loaded.collect()}
    assert {i: r.hits for i, r in got.items()} == dict(enumerate(HITS.values())) | {99: "3"}
    assert [i for i, r in got.items() if r.no_hits] == [0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW branch_rows AS SELECT * FROM '{tmp_path}/branch_rows.parquet/*.parquet'")
    cur = con.execute(preparation.ORACLE["p1_branch_records"])
    assert [x[0] for x in cur.description] == loaded.columns
    assert {r[0]: r for r in cur.fetchall()} == {i: tuple(r) for i, r in got.items()}


SHARDS = [
    (1, "TN:a\nSF:/x\nDA:1,1\nDA:2,0\nLF:2\nLH:1\nend_of_record\n"), (2, "# c\r\nTN:a\r\nKF:/x\r\nDA:2,0\r\n\r\nDA:1,1\r\nend_of_record"), (3, "TN:a\nSF:/x\nDA:1,1\nDA:1,1\nDA:2,0\nend_of_record\n"),
    (4, "TN:b\nSF:/x\nDA:1,1\nDA:2,0\nend_of_record\n"), (5, None), (6, ""), (7, "SF:/e\nend_of_record\nTN:a\nSF:/x\nDA:1,1\nDA:2,0\nend_of_record\n"), (8, "SF:/e\nLF:3\n"), (9, "SF:/e\n"), (9, "SF:/e\n")]


def test_compaction(spark, tmp_path):
    files = f"file:{tmp_path}/files"
    assert compactor.write_files(spark.createDataFrame(SHARDS, "input_id bigint, body string").repartition(4), files) == 10
    assert compactor.write_files(spark.createDataFrame(SHARDS[:3], "input_id bigint, body string"), files) == 3
    assert len(list((tmp_path / "files").glob("*/*.info"))) == 9
    one = compactor.Compactor(spark, str(tmp_path / "out"), files_per_batch=2)
    one.run(files, compactor.FILE_ID)
    expected = [(1, 2), (1, 7), (2, 7), (7, 8), (7, 9), (8, 9)]
    pairs = lambda c: sorted(tuple(r) for r in compactor.shared_pairs(c.members()).collect())
    assert pairs(one) == expected and one.sections().count() == 4
    batches = len(one.sizes())
    assert batches >= 4
    # nothing new: nothing is read or written again; a batch written twice replaces itself
    one.run(files, compactor.FILE_ID)
    again = spark.createDataFrame(SHARDS[:2], "input_id bigint, body string")
    one.write_batch(again, batches)
    one.write_batch(again, batches)
    assert one.sections().count() == 4 and one.members().count() == 8
    # one file is left, and later batches still see what it holds
    one.consolidate()
    assert [n for _, n in one.sizes()] == [1] and [n for _, n in one.sizes("members")] == [1]
    assert one.sections().count() == 4 and pairs(one) == expected
    (tmp_path / "files" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "files" / "deep" / "er" / "50.info").write_text("TN:a\nSF:/x\nDA:2,0\nDA:1,1\nend_of_record\nSF:/new\nend_of_record\n")
    one.run(files, compactor.FILE_ID)
    one.consolidate()
    assert one.sections().count() == 5 and len(one.sizes()) == 1 and (1, 50) in pairs(one)
    two = compactor.Compactor(spark, str(tmp_path / "out2"))
    two.run(str(tmp_path / "files"))
    assert two.sections().count() == 5
    three = compactor.Compactor(spark, str(tmp_path / "out3"))
    assert three.sections().count() == 0 and compactor.shared_pairs(three.members()).count() == 0
    assert compactor.compact_table(spark, spark.createDataFrame([], "input_id bigint, body string, path int")).members().count() == 0


def test_compacted_files_have_the_target_size(spark, tmp_path):
    rng = random.Random(8)
    shards = [(k, f"SF:/p{k % 100}\n" + "".join(f"DA:{rng.randrange(10**6)},{rng.randrange(10**6)}\n" for _ in range(60)) + "end_of_record\n") for k in range(1200)]
    compactor.write_files(spark.createDataFrame(shards, "input_id bigint, body string"), str(tmp_path / "files"))
    target = 64 << 10
    one = compactor.Compactor(spark, str(tmp_path / "out"), target_bytes=target, files_per_batch=150)
    one.run(str(tmp_path / "files"))
    one.consolidate()
    total, files = (sum(x) for x in zip(*one.sizes()))
    assert one.sections().count() == 1200 and total / target / 2 <= files <= 2 * total / target + 1
    sizes = [p.stat().st_size for p in (tmp_path / "out" / "sections").glob("*/part-*")]
    assert len(sizes) == files and max(sizes) < 2 * target


def test_links_of_hot_sections(spark, monkeypatch):
    rng = random.Random(6)
    # one section in most inputs, a large class of copies, and rare sections
    held = {k: {"hot"} if k < 40 else {x for x in ["hot"] if rng.random() < 0.7} | {f"s{rng.randrange(30)}" for _ in range(rng.randrange(3))} for k in range(120)}
    members = spark.createDataFrame([(k, s) for k, own in held.items() for s in own], "input_id bigint, section_id string")
    expected = {(a, b) for a in held for b in held if a < b and held[a] & held[b]}
    for block in (1024, 7):
        monkeypatch.setattr(compactor, "BLOCK", block)
        got = [tuple(r) for r in compactor.shared_pairs(members).collect()]
        assert len(got) == len(expected) and set(got) == expected
        links = {r.input_id: (r.class_id, r.size, r.links) for r in compactor.linked_inputs(members).collect()}
        same = {k: [j for j in held if held[j] == held[k]] for k in held}
        assert links == {k: (min(same[k]), len(same[k]), sum(k in p for p in expected)) for k in held if held[k]}


def test_heavy_keys(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else rng.choice([None, "a", "é", "z"]), rng.choice([None, 0, 1, 2**64 - 1, rng.randrange(2**64), rng.randrange(300)])) for _ in range(1500)]
    df = spark.createDataFrame([(k, None if v is None else str(v), 1) for k, v in rows], "path string, value string, key int")
    df = df.withColumn("value", F.col("value").cast("decimal(20,0)"))
    expected = {}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        n = len(values)
        counts = {v: values.count(v) for v in values}
        expected[key] = (sum(k == key for k, _ in rows), len(counts), min(v for v in counts if counts[v] == max(counts.values())), *[values[max(1, -(-n * p // 100)) - 1] for p in (50, 90, 99)])
    for pieces in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", pieces)
        got = heavy.profile(df, "path", "value").collect()
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        assert {r.key: (r.n_rows, r.n_distinct, int(r.mode), int(r.p50), int(r.p90), int(r.p99)) for r in got} == expected
    splitters = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, "é"), (2, None), (None, "b")], "plan_id int, splitter string")
    found = heavy.with_ranges(heavy.heavy_keys(heavy.compress(df, "path", "value"), 30), splitters).collect()
    assert sorted((r.plan_id, r.range_no, r.key) for r in found) == [(1, 1, "hot"), (2, 0, "hot")]
    empty = df.limit(0)
    assert heavy.profile(empty, "path", "value").count() == 0 and heavy.heavy_keys(heavy.compress(empty, "path", "value")).count() == 0


def test_copy_differences(spark):
    rng = random.Random(7)
    make = lambda k: (k // 500, f"p{k % 500:03}", k, None if k % 7 == 0 else k * 2, k)
    a = [make(k) for k in range(3000)]
    b = [(x, p, m, n, t) for x, p, m, n, t in a]
    expected = set()
    for k in rng.sample(range(3000), 60):
        x, p, m, n, t = b[k]
        if k % 3 == 0:
            b[k] = None
            expected.add((x, p, "only_a", None, None))
        else:
            b[k] = (x, p, m + 1, 5, t)
            expected |= {(x, p, "m", str(m), str(m + 1)), (x, p, "n", None if n is None else str(n), "5")}
    b = [r for r in b if r] + [(9, "new", 1, None, 0), (None, None, 1, 1, 1)]
    expected |= {(9, "new", "only_b", None, None), (None, None, "only_b", None, None)}
    stale = [(x, p, -1, -1, t - 1) for x, p, _, _, t in rng.sample(a, 50)]
    schema = "build bigint, path string, m bigint, n bigint, t bigint"
    rng.shuffle(b)
    left, right = spark.createDataFrame(a + a[:100] + stale, schema).withColumn("field", F.lit(1)), spark.createDataFrame(b, schema)
    got = copydiff.copy_differences(left, right, ("build", "path"), ("m", "n"), "t").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    chunked = copydiff.differing_rows(copydiff.latest(left, ("build", "path"), ("m", "n"), "t"), copydiff.latest(right, ("build", "path"), ("m", "n"), "t"), ("build", "path"), ("m", "n"))
    assert chunked.count() < 5000
    assert copydiff.copy_differences(right.limit(0), right, ("build", "path"), ("m", "n"), "t").filter("field = 'only_b'").count() == right.count()
    assert copydiff.copy_differences(right, right, ("build", "path"), ("m", "n"), "t").count() == 0


def test_drift(spark):
    files = {
        1: [{"section_id": 1, "lines": 3, "modern": True, "x": "q", "same": 1}, {"section_id": 2, "lines": 4, "modern": False, "x": "r", "same": None}],
        2: [{"section_id": 1, "n_lines": 3, "modern": 1, "y": "q", "same": 1.5}, {"section_id": 2, "n_lines": None, "modern": 0, "y": "other", "same": 2}],
        3: [{"section_id": 3, "n_lines": 9, "modern": 1, "Modern": [1], "same": 2.0}],
    }
    import json

    rows = [(1, seq, "f", k, json.dumps(body), "clash") for seq, bodies in files.items() for k, body in enumerate(bodies)]
    rows += rows[:2] + [(2, 1, "g", 0, "not json", "c"), (2, 1, "g", 1, None, "c"), (2, 1, "g", 2, "[1]", "c"), (2, 2, "g", 0, "{}", "c")]
    df = spark.createDataFrame(rows, "feed_id int, file_seq int, file_name string, row_no int, body string, field string")
    got = {(r.file_seq, r.field, r.change, r.old_field) for r in drift.changes(df).filter("feed_id = 1").collect()}
    assert got == {(2, "n_lines", "renamed", "lines"), (2, "modern", "retyped", None), (2, "same", "retyped", None), (2, "x", "removed", None), (2, "y", "added", None), (3, "y", "removed", None), (3, "Modern", "added", None)}
    assert drift.changes(df).filter("feed_id = 2").count() == 0
    assert drift.unreadable(df).count() == 3
    table = {(r.file_seq, r.row_no): r for r in drift.consistent(df).filter("feed_id = 1").collect()}
    assert len(table) == 5
    assert [(table[k].lines, table[k].modern, table[k].failed) for k in ((1, 0), (2, 0), (2, 1))] == [(3.0, True, ""), (3.0, True, ""), (None, False, "")]
    assert drift.changes(df.limit(0)).count() == 0 and drift.consistent(df.limit(0)).count() == 0


def test_every_rename_is_found(spark):
    # a, b -> c, d agree alike in all four pairs; p, q -> r, s: r's best partner q goes to s, which leaves p for r
    before = [{"section_id": k, "a": True, "b": True, "p": "v" if k < 2 else None, "q": "v"} for k in range(3)]
    after = [{"section_id": k, "c": True, "d": True, "r": "v" if k < 2 else None, "s": "v"} for k in range(3)]
    import json

    rows = [(1, seq, "f", k, json.dumps(body)) for seq, bodies in ((1, before), (2, after), (3, after)) for k, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, "feed_id int, file_seq int, file_name string, row_no int, body string")
    got = {(r.file_seq, r.field, r.change, r.old_field) for r in drift.changes(df).collect()}
    assert got == {(2, "d", "renamed", "b"), (2, "c", "renamed", "a"), (2, "s", "renamed", "q"), (2, "r", "renamed", "p")}


def test_consistent_table(spark):
    import json

    big = 2**60 + 1
    feeds = {
        1: [[{"section_id": 1, "lines": 3}], [{"section_id": 1, "n": 3}], [{"section_id": 1, "m": 3}, {"section_id": 2, "m": big}], [{"section_id": 2, "m": big, "lines": 7, "x": [1]}, {"section_id": 3, "m": 7, "lines": 7}]],
        2: [[{"section_id": 1, "n": 5, "modern": "maybe"}], [{"section_id": 1, "n": "6", "modern": "No", "source": "s"}]],
        3: [[{"section_id": 1, "a": "q", "version": 1.5}], [{"section_id": 1, "b": "q", "version": None}], [{"section_id": "x", "b": "r"}]],
    }
    rows = [(feed, seq, "f", k, json.dumps(body)) for feed, files in feeds.items() for seq, bodies in enumerate(files, 1) for k, body in enumerate(bodies)]
    df = spark.createDataFrame(rows + rows[:3], "feed_id int, file_seq int, file_name string, row_no int, body string")
    got = {(r.feed_id, r.file_seq, r.row_no): r for r in drift.consistent(df).collect()}
    assert len(got) == len(rows)
    # lines -> n -> m in feed 1 only; two different values of one field are a failure and are kept
    assert [int(got[1, k, 0].lines) for k in (1, 2, 3)] == [3, 3, 3] and int(got[1, 3, 1].lines) == big
    both = got[1, 4, 0]
    assert (both.lines, both.failed, [tuple(e) for e in both.extra]) == (None, "lines", [("lines", str(big)), ("lines", "7"), ("x", "[1]")]) and int(got[1, 4, 1].lines) == 7
    assert got[2, 1, 0].lines is None and [tuple(e) for e in got[2, 1, 0].extra] == [("modern", '"maybe"'), ("n", "5")] and got[2, 1, 0].failed == "modern" and got[2, 2, 0].modern is False and got[2, 2, 0].source == "s"
    assert [[tuple(e) for e in got[3, k, 0].extra][-1] for k in (1, 2, 3)] == [("a", '"q"'), ("a", '"q"'), ("section_id", '"x"')] and got[3, 1, 0].version == "1.5" and got[3, 3, 0].failed == "section_id"


@pytest.mark.parametrize("seed", [1])
def test_split_record_round_trip(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        fields = ["".join(rng.choice('a",\n\r é') for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 5))]
        raw = ",".join('"' + f.replace('"', '""') + '"' if '"' in f or "," in f or rng.random() < 0.3 else f for f in fields)
        assert split_record(raw) == fields
