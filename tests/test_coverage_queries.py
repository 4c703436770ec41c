"""Coverage operators: the registered queries against their SQL on the smallest tables, and edge rows by hand."""

import importlib
import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import coverage as op
from tracemill.plans import coverage, native, preparation

DATA = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings records splitters branch_rows shards totals_a totals_b section_rows".split()


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["da_merge", "record_merge", "record_summary", "branch_canonical", "range_first_hit", "derive_end", "lcov_render", "compat_lines", "compat_texts", "compat_final_functions", "p4_found", "p5_found"])
def test_same_as_sql(spark, con, name):
    module = coverage if name in coverage.QUERIES else preparation
    df = module.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cur = con.execute(module.ORACLE[name])
    order = [x[0] for x in cur.description]
    assert sorted(order) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[order.index(c)] for c in columns)) for r in cur.fetchall())


def test_every_query_but_the_unordered_has_sql():
    assert set(coverage.QUERIES) - set(coverage.ORACLE) == {"compat_render"}
    assert set(preparation.QUERIES) == set(preparation.ORACLE)


def test_edges(spark):
    rows = spark.createDataFrame([("a", 1, None, None), ("a", 1, None, ""), (None, 1, 5, "x"), ("b", 2, 2**62, "y"), ("b", 2, 2**62, "x")], "source string, line bigint, count bigint, checksum string")
    got = {(r.source, r.line): (r["count"], r.checksum, r.conflict) for r in op.merge_lines(rows, ["source", "line"]).collect()}
    assert got == {("a", 1): (None, "", False), (None, 1): (5, "x", False), ("b", 2): (2**63, "x", True)}
    assert op.merge_counts(rows, ["source"], limit=2**63 - 1).filter("source = 'b'").collect()[0]["count"] == 2**63 - 1
    ranges = spark.createDataFrame([("a", 1, 3, "r"), ("a", 2, 2, "s"), ("z", 1, 9, "t")], "source string, first bigint, last bigint, line string")
    hit = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 2, 1)], "source string, at bigint, n bigint")
    assert sorted((r.line, r.first_hit) for r in op.first_hit_in_range(hit, ranges, ["source"], "at", "n", "first", "last").collect()) == [("r", 2), ("s", 2), ("t", None)]
    empty = rows.limit(0)
    assert op.merge_lines(empty, ["source"]).count() == 0 and op.single_label(empty, "source", "checksum").count() == 0
    assert native.grand_totals(native.source_summaries(native.merge_records(spark.createDataFrame([], "path string, kind tinyint, a decimal(20,0), b decimal(20,0), c decimal(20,0), value decimal(20,0), text string, extra string, flags int")))).collect()[0].lf == 0


def test_numbers(spark):
    from tracemill.functions.numbers import extension, lenient_count, normalized_testcase, u64

    texts = ["0", "007", "18446744073709551615", "18446744073709551616", "-1", "", " 1", "1.9", "1e3", ".5", "-0", "-0.5", "inf", "nan", "1f", "+4", "9" * 40, "0" * 50 + "3", "9007199254740993"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", u64(F.col("t")).alias("u"), lenient_count(F.col("t")).alias("c")).collect()
    u = {r.t: None if r.u is None else int(r.u) for r in rows}
    c = {r.t: (None if r.c.value is None else int(r.c.value), r.c.error) for r in rows}
    assert u == {t: int(t) if t.isdigit() and int(t) < 2**64 else None for t in texts}
    top = 2**63 - 1
    assert c == {"0": (0, None), "007": (7, None), "18446744073709551615": (top, None), "18446744073709551616": (top, None), "-1": (0, "negative"), "": (None, "format"), " 1": (None, "format"), "1.9": (1, None), "1e3": (1000, None), ".5": (0, None),
                 "-0": (0, None), "-0.5": (0, "negative"), "inf": (None, "format"), "nan": (None, "format"), "1f": (None, "format"), "+4": (4, None), "9" * 40: (top, None), "0" * 50 + "3": (3, None), "9007199254740993": (9007199254740993, None)}
    names = spark.createDataFrame([("a-b,ignored",), ("a,diff",), ("é",), ("x  ",), ("",)], "t string").select(normalized_testcase(F.col("t")).alias("n")).collect()
    assert [r.n for r in names] == ["a_b", "a,diff", "__", "x", ""]
    assert [r.e for r in spark.createDataFrame([("/a/b.c",), ("x.tar.gz",), ("/.hid",), ("no",)], "t string").select(extension(F.col("t")).alias("e")).collect()] == ["c", "gz", "", ""]


COUNTS = {"9223372036854775806": 2**63 - 2, "9223372036854775807": 2**63 - 1, "9223372036854775808": 2**63 - 1, "18446744073709551616": 2**63 - 1, "0" * 30 + "12": 12, "+" + "9" * 60: 2**63 - 1, "9" * 400: 2**63 - 1,
          "9223372036854774784.0": 2**63 - 1024, "9223372036854775808.0": 2**63 - 1, "1e18": 10**18, "1e30": 2**63 - 1, "1e-30": 0, "-1e30": 0, "1e999": None, "0.000000000000000000001": 0, "": None, "-": None, "x": None}


def test_counts_of_any_length(spark, tmp_path):
    import duckdb

    texts = list(COUNTS)
    spark.createDataFrame([(i, f"1,1,0,v,0,{t},x") for i, t in enumerate(texts)] + [(98, "1,2"), (99, None)], "row_id bigint, raw string").coalesce(1).write.parquet(f"{tmp_path}/branch_rows.parquet")
    got = {r.row_id: (r.hits, r.value) for r in coverage.QUERIES["parse_count"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(COUNTS.items()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW branch_rows AS SELECT * FROM '{tmp_path}/branch_rows.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(coverage.ORACLE["parse_count"]).fetchall()} == got


def test_round_trip_counts_every_kind(spark, tmp_path):
    import duckdb

    section = "SF:/a.c\nFN:1,f\nFNDA:2,f\nBRDA:1,0,x == 1,-\nBRDA:1,0,1,3\nDA:1,2\nend_of_record\n"
    spark.createDataFrame([(1, "TN:t\n" + section), (2, "TN:t\n" + section.replace("DA:1,2", "DA:1,2\nDA:4,0")), (3, "TN:u\n" + section.replace("/a.c", "/b.c").replace(",-", ",5"))], "input_id bigint, body string").coalesce(1).write.parquet(f"{tmp_path}/shards.parquet")
    got = {(r.side, r.tag): (r.n, r.hits) for r in coverage.QUERIES["lcov_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {("shards", t): (n, h) for t, n, h in (("TN", 3, None), ("SF", 3, None), ("group", 3, None), ("FN", 3, None), ("FNDA", 3, "6"), ("BRDA", 4, "14"), ("BRDA-", 2, None), ("DA", 4, "6"))} | {
        ("rendered", t): (n, h) for t, n, h in (("TN", 2, None), ("SF", 2, None), ("group", 2, None), ("FN", 2, None), ("FNDA", 2, "6"), ("BRDA", 3, "14"), ("BRDA-", 1, None), ("DA", 3, "6"))}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW shards AS SELECT * FROM '{tmp_path}/shards.parquet/*.parquet'")
    assert {r[:2]: r[2:] for r in con.execute(coverage.ORACLE["lcov_roundtrip"]).fetchall()} == got


def test_text_operators_are_optional():
    import __spark_entry__ as entry

    assert "da_merge" in entry.queries() and ("p6_ids" in entry.queries()) == ("tracemill.llm.queries" in entry.MODULES)


def test_text_operators_that_fail_to_import_are_left_out(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "tracemill.llm.queries", None)
    again = importlib.reload(entry)
    assert "tracemill.llm.queries" not in again.MODULES and "da_merge" in again.queries()
    monkeypatch.undo()
    importlib.reload(entry)
