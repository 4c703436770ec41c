"""Registered queries of the coverage operators, each beside its SQL for the oracle.

The driver's star schema is projected into coverage rows by the same text in both engines; the ``records`` table holds
parsed records already and goes through the same merge that reads tracefiles.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import numbers, paths
from tracemill.operators import coverage as op
from tracemill.plans import native
from tracemill.plans.compat import CompatMerge, Options
from tracemill.session import materialize, table
from tracemill.sources.lcov import records_from_table

LINES = """SELECT concat('/src/pkg', l_suppkey % 4, '/file_', l_partkey % 50, '.c') AS source, l_returnflag AS testcase, CAST(l_orderkey % 3 AS BIGINT) AS input_id,
 l_orderkey AS section, CAST(l_linenumber + 7 * (l_orderkey % 9) AS BIGINT) AS line, CASE WHEN l_discount < 0.03 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS count,
 CASE WHEN l_linestatus = 'F' THEN substr(md5(concat('', l_partkey % 7)), 1, 4) END AS checksum FROM lineitem"""
BRANCHES = """SELECT concat('/src/pkg', l_suppkey % 4, '/file_', l_partkey % 50, '.c') AS source, l_returnflag AS testcase, CAST(l_orderkey % 3 AS BIGINT) AS input_id, l_orderkey AS section,
 CAST(l_linenumber + 7 * (l_orderkey % 11) AS BIGINT) AS line, CAST(l_suppkey % 3 AS BIGINT) AS block, CAST(l_partkey AS BIGINT) AS ordinal, CASE l_partkey % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'e' ELSE 'f' END AS kind,
 CASE WHEN l_tax < 0.02 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 5 END AS hits, concat('x', l_partkey % 10) AS expr FROM lineitem"""
CONDITIONS = """SELECT concat('/src/pkg', l_suppkey % 4, '/file_', l_partkey % 50, '.c') AS source, l_returnflag AS testcase, CAST(l_orderkey % 3 AS BIGINT) AS input_id, CAST(l_linenumber + 7 * (l_orderkey % 13) AS BIGINT) AS line,
 CAST(l_suppkey % 2 AS BIGINT) AS grp, CAST(l_partkey % 5 AS BIGINT) AS idx, CASE WHEN l_tax < 0.05 THEN 't' ELSE 'f' END AS sense, CAST(l_quantity AS BIGINT) % 3 AS hits, concat('c', l_partkey % 5, CASE WHEN l_tax > 0.07 THEN '!' ELSE '' END) AS expr FROM lineitem"""
FUNCTIONS = """SELECT concat('/src/pkg', p_partkey % 4, '/file_', p_partkey % 50, '.c') AS source, CAST(p_size AS BIGINT) AS start, CAST(p_size + p_partkey % 6 AS BIGINT) AS stop, concat('fn_', p_partkey % 40) AS name,
 CAST(p_partkey % 3 AS BIGINT) AS input_id, CAST(floor(p_retailprice) AS BIGINT) % 4 AS hits FROM part"""
#: Declarations and hits of symbols in the order of a stream of events.
SYMBOLS = "SELECT user_id, event_id, event_type, CASE WHEN event_type = 'click' THEN event_id END AS declared FROM events"
PATHS = "SELECT doc_id, concat('/old/tree/', coalesce(source, 'none'), '/f_', doc_id % 20, '.c') AS path FROM documents"

QUERIES, ORACLE = {}, {}


def _sql(spark: SparkSession, d: str, text: str, *names: str) -> DataFrame:
    """A projection over tables of ``d``, whose names become references to their files."""
    for name in names:
        text = text.replace(f"FROM {name}", f"FROM parquet.`{d}/{name}.parquet`")
    return spark.sql(text)


def lines(spark, d):
    return _sql(spark, d, LINES, "lineitem")


def branches(spark, d):
    return _sql(spark, d, BRANCHES, "lineitem")


def conditions(spark, d):
    return _sql(spark, d, CONDITIONS, "lineitem")


def functions(spark, d):
    return _sql(spark, d, FUNCTIONS, "part")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH cov_da AS ({LINES}), cov_br AS ({BRANCHES}), cov_mc AS ({CONDITIONS}), cov_fn AS ({FUNCTIONS}), sym AS ({SYMBOLS}), paths AS ({PATHS}) " + sql
        return f

    return register


def _whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


PLACE = ["source", "line"]


@query("SELECT source, line, sum(count)::BIGINT AS count, coalesce(min(checksum), '') AS checksum, coalesce(min(checksum) <> max(checksum), false) AS conflict FROM cov_da GROUP BY source, line")
def da_merge(spark, d):
    return _whole(op.merge_lines(lines(spark, d), PLACE), "count")


@query("SELECT source, testcase, line, sum(count)::BIGINT AS count FROM cov_da GROUP BY ALL")
def da_merge_by_testcase(spark, d):
    return _whole(op.merge_counts(lines(spark, d), ["source", "testcase", "line"], limit=numbers.I64_MAX), "count")


@query("SELECT path, a::VARCHAR AS line, least(sum(value::HUGEINT), 18446744073709551615)::VARCHAR AS total FROM records WHERE kind = 8 AND path IS NOT NULL GROUP BY path, a")
def saturating_sum(spark, d):
    rows = table(spark, d, "records").filter("kind = 8 AND path IS NOT NULL")
    merged = op.merge_counts(rows, ["path", "a"], "value")
    return merged.select("path", F.col("a").cast("string").alias("line"), F.col("value").cast("string").alias("total"))


@query("SELECT source, line, block, kind, sum(hits)::BIGINT AS hits FROM cov_br GROUP BY ALL")
def branch_merge(spark, d):
    return _whole(op.merge_counts(branches(spark, d), [*PLACE, "block", "kind"], "hits"), "hits")


@query("SELECT path, CASE WHEN count(DISTINCT coalesce(tn, '')) = 1 THEN max(coalesce(tn, '')) ELSE '' END AS tn FROM records WHERE path IS NOT NULL GROUP BY path")
def testcase_label(spark, d):
    return op.single_label(table(spark, d, "records").filter("path IS NOT NULL"), "path", "tn")


@query("SELECT source, name, sum(hits)::BIGINT AS hits, arg_min(start, (input_id, start)) AS start, min(start) <> max(start) AS moved FROM cov_fn GROUP BY source, name")
def function_merge(spark, d):
    f = functions(spark, d)
    first = op.first_by(f, ["source", "name"], "start", ["input_id"]).withColumnRenamed("conflict", "moved")
    return _whole(op.merge_counts(f, ["source", "name"], "hits").join(first, ["source", "name"]), "hits")


@query("SELECT DISTINCT source, start, stop, name FROM cov_fn")
def function_dedupe(spark, d):
    return functions(spark, d).select("source", "start", "stop", "name").distinct()


@query("SELECT source, start, coalesce(bool_or(hits > 0), false) AS hit, max(stop) AS stop, min(stop) <> max(stop) AS conflict FROM cov_fn GROUP BY source, start")
def function_groups(spark, d):
    return op.group_hits(functions(spark, d), ["source", "start"], "hits", "stop")


@query("SELECT source, line, grp, idx, sense, sum(hits)::BIGINT AS hits, min(expr) AS expr, min(expr) <> max(expr) AS mismatch FROM cov_mc GROUP BY ALL")
def mcdc_merge(spark, d):
    keys = [*PLACE, "grp", "idx", "sense"]
    c = conditions(spark, d)
    chosen = op.merge_lines(c.withColumnRenamed("expr", "checksum").withColumnRenamed("hits", "count"), keys)
    return _whole(chosen.select(*keys, F.col("count").alias("hits"), F.col("checksum").alias("expr"), F.col("conflict").alias("mismatch")), "hits")


@query("SELECT source, input_id, line, grp, idx, count(DISTINCT expr) AS expressions FROM cov_mc GROUP BY ALL HAVING count(DISTINCT expr) > 1")
def mcdc_mismatch(spark, d):
    keys = ["source", "input_id", "line", "grp", "idx"]
    return conditions(spark, d).select(*keys, "expr").distinct().groupBy(*keys).agg(F.count("expr").alias("expressions")).filter("expressions > 1")


@query("SELECT source, count(*) AS lf, count(*) FILTER (count > 0) AS lh FROM (SELECT source, line, sum(count) AS count FROM cov_da GROUP BY ALL) GROUP BY source")
def source_summary(spark, d):
    return op.rollup_summary(op.merge_counts(lines(spark, d), PLACE), "source", "count").filter("source IS NOT NULL")


@query("SELECT count(*) AS lf, count(*) FILTER (count > 0) AS lh FROM (SELECT source, line, sum(count) AS count FROM cov_da GROUP BY ALL)")
def grand_totals(spark, d):
    return op.rollup_summary(op.merge_counts(lines(spark, d), PLACE), "source", "count").filter("source IS NULL").select("lf", "lh")


@query("SELECT source, count(*) AS lf, count(*) FILTER (count > 0) AS lh FROM (SELECT source, line, sum(count) AS count FROM cov_da GROUP BY ALL) GROUP BY ROLLUP(source)")
def summary_rollup(spark, d):
    return op.rollup_summary(op.merge_counts(lines(spark, d), PLACE), "source", "count")


_NAME = "CASE WHEN kind IN (4, 5, 9) OR (kind = 6 AND flags & 1 = 0) THEN coalesce(text, '') WHEN kind = 3 AND flags & 1 = 0 THEN coalesce(extra, '') ELSE '' END"
_MERGED = f"""m AS (SELECT path, kind::INTEGER AS kind, a, b, CASE WHEN kind = 6 AND flags & 1 = 0 THEN 0 ELSE coalesce(c, 0) END AS c, {_NAME} AS name,
 CASE WHEN kind = 6 THEN flags & 59 WHEN kind = 7 THEN flags & 192 WHEN kind IN (3, 4) THEN flags & 1 ELSE 0 END AS bits,
 CASE WHEN sum(CASE WHEN kind = 6 AND flags & 4 <> 0 THEN NULL ELSE coalesce(value, 0)::HUGEINT END) > 18446744073709551615 THEN 18446744073709551615::HUGEINT ELSE sum(CASE WHEN kind = 6 AND flags & 4 <> 0 THEN NULL ELSE coalesce(value, 0)::HUGEINT END) END AS value, count(*) AS copies,
 coalesce(min(CASE WHEN kind IN (1, 7) THEN coalesce(text, '') WHEN kind = 8 THEN nullif(extra, '') END), '') AS chosen,
 coalesce(max(CASE WHEN kind IN (1, 7) THEN coalesce(text, '') WHEN kind = 8 THEN nullif(extra, '') END), '') AS most FROM records WHERE path IS NOT NULL GROUP BY ALL)"""


def _merged(spark, d):
    return native.merge_records(table(spark, d, "records"))


def record_merge(spark, d):
    """The whole merge of parsed records, all families at once."""
    text = [F.col(c).cast("string").alias(c) for c in ("a", "b", "c")]
    return _merged(spark, d).select("path", F.col("kind").cast("int").alias("kind"), *text, "name", F.col("flags").alias("bits"), F.col("value").cast("string").alias("value"), F.col("copies").cast("bigint").alias("copies"), "chosen")


def record_summary(spark, d):
    return native.source_summaries(_merged(spark, d))


def record_totals(spark, d):
    return native.grand_totals(native.source_summaries(_merged(spark, d)))


def lcov_render(spark, d):
    """The merged tracefile's lines in order, each with its source and its place among the kinds of lines."""
    merged = _merged(spark, d)
    return native.rendered_lines(merged, native.source_summaries(merged)).orderBy(*native.ORDER).select("path", "rank", "line")


_SUMMARY = """, s AS (SELECT path, count(*) FILTER (kind = 3) AS fnf, count(DISTINCT CASE WHEN kind = 4 AND bits & 1 <> 0 AND value > 0 THEN (a, b, c) END) + count(*) FILTER (kind = 5 AND value > 0) AS fnh,
 count(*) FILTER (kind = 6 AND bits & 32 = 0) AS brf, count(*) FILTER (kind = 6 AND bits & 32 = 0 AND value > 0) AS brh, count(*) FILTER (kind = 7 AND bits & 128 = 0) AS mcf,
 count(*) FILTER (kind = 7 AND bits & 128 = 0 AND value > 0) AS mch, count(*) FILTER (kind = 8) AS lf, count(*) FILTER (kind = 8 AND value > 0) AS lh FROM m GROUP BY path)"""
_TOTALS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in native.SUMMARY_ORDER)
QUERIES |= {f.__name__: f for f in (record_merge, record_summary, record_totals, lcov_render)}
ORACLE |= {
    "record_merge": f"WITH {_MERGED} SELECT path, kind, a::VARCHAR AS a, b::VARCHAR AS b, c::VARCHAR AS c, name, bits, value::VARCHAR AS value, copies, chosen FROM m",
    "record_summary": f"WITH {_MERGED}{_SUMMARY} SELECT * FROM s",
    "record_totals": f"WITH {_MERGED}{_SUMMARY} SELECT {_TOTALS} FROM s",
    "lcov_render": f"""WITH {_MERGED}{_SUMMARY}, texts AS (SELECT path, CASE kind WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 4 - (bits & 1) WHEN 4 THEN 4 - (bits & 1) WHEN 5 THEN 5 WHEN 8 THEN 6 WHEN 6 THEN 7 WHEN 7 THEN 8 ELSE 9 END AS rank, copies, kind, CASE
 WHEN kind = 1 AND chosen = most AND chosen <> '' THEN 'TN:' || chosen WHEN kind = 2 THEN 'SF:' || path WHEN kind = 3 AND bits & 1 = 1 THEN 'FNL:' || c::VARCHAR || ',' || a::VARCHAR || CASE WHEN b <> 0 THEN ',' || b::VARCHAR ELSE '' END
 WHEN kind = 4 AND bits & 1 = 1 THEN 'FNA:' || c::VARCHAR || ',' || value::VARCHAR || ',' || name WHEN kind = 4 THEN 'FN:' || a::VARCHAR || CASE WHEN b <> 0 THEN ',' || b::VARCHAR ELSE '' END || ',' || name WHEN kind = 5 THEN 'FNDA:' || value::VARCHAR || ',' || name
 WHEN kind = 6 THEN 'BRDA:' || a::VARCHAR || ',' || CASE WHEN bits & 8 <> 0 THEN 'e' ELSE '' END || CASE WHEN bits & 16 <> 0 THEN 'f' ELSE '' END || CASE WHEN bits & 32 <> 0 THEN 'U' ELSE '' END || b::VARCHAR || ',' || CASE WHEN bits & 1 <> 0 THEN c::VARCHAR ELSE name END || ',' || coalesce(value::VARCHAR, '-')
 WHEN kind = 7 THEN 'MCDC:' || a::VARCHAR || ',' || CASE WHEN bits & 128 <> 0 THEN 'U' ELSE '' END || b::VARCHAR || ',' || CASE WHEN bits & 64 <> 0 THEN 't' ELSE 'f' END || ',' || value::VARCHAR || ',' || c::VARCHAR || ',' || chosen
 WHEN kind = 8 THEN 'DA:' || a::VARCHAR || ',' || value::VARCHAR || CASE WHEN chosen <> '' THEN ',' || chosen ELSE '' END WHEN kind = 9 THEN name END AS line FROM (SELECT * REPLACE (coalesce(a, 0) AS a, coalesce(b, 0) AS b) FROM m))
SELECT path, rank::INTEGER AS rank, line FROM (SELECT path, rank, line, unnest(range(CASE WHEN kind = 9 THEN copies ELSE 1 END)) FROM texts WHERE line IS NOT NULL)
UNION ALL SELECT path, 10, {" || chr(10) || ".join(f"'{c.upper()}:' || {c}::VARCHAR" for c in native.SUMMARY_ORDER)} || chr(10) || 'end_of_record' FROM s""",
}


_TAGS = {1: "TN", 2: "SF", 3: "group", 4: "FN", 5: "FNDA", 6: "BRDA", 7: "MCDC", 8: "DA", 9: "other"}


def lcov_roundtrip(spark, d):
    """Records of the tracefiles in ``shards``, and those parsed again from the lines of their merge, by kind.

    ``n`` counts named TN rows only; ``hits`` is null for kinds without a count. BRDA rows with ``-`` and malformed lines are kinds of their own.
    """
    records = materialize(records_from_table(table(spark, d, "shards")), "roundtrip")
    merged = native.merge_records(records.filter("kind IS NOT NULL"))
    line = F.struct(*native.ORDER[1:], "line")
    ordered = native.rendered_lines(merged, native.source_summaries(merged)).groupBy("path").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    again = records_from_table(ordered.select(F.xxhash64("path").alias("input_id"), F.concat(F.array_join("lines.line", "\n"), F.lit("\n")).alias("body")))
    kind = F.col("kind")
    dash = (kind == 6) & (F.col("flags").bitwiseAND(native.DASH) != 0)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in _TAGS.items() for x in pair]), kind.cast("int"))
    tag = F.when(F.col("error").isNotNull(), "error").when(dash, "BRDA-").otherwise(named)
    both = records.withColumn("side", F.lit("shards")).unionByName(again.withColumn("side", F.lit("rendered")))
    counted = both.filter("error IS NOT NULL OR (kind IS NOT NULL AND NOT (kind = 1 AND text = ''))")
    hits = F.when(kind.isin(5, 6, 7, 8) & ~dash, F.col("value"))
    return counted.groupBy("side", tag.alias("tag")).agg(F.count("*").alias("n"), F.sum(hits).cast("string").alias("hits"))


QUERIES["lcov_roundtrip"] = lcov_roundtrip
ORACLE["lcov_roundtrip"] = r"""WITH l AS (SELECT input_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM (SELECT input_id, string_split(replace(body, chr(13), ''), chr(10)) AS ls FROM shards)),
w AS (SELECT x, string_split(x, ':')[1] AS tag, last_value(CASE WHEN x[1:3] IN ('SF:', 'KF:') THEN x[4:] END IGNORE NULLS) OVER f AS section, lead(x[4:]) OVER f AS coming FROM l WHERE x <> '' AND x[1] <> '#' WINDOW f AS (PARTITION BY input_id ORDER BY i)),
r AS (SELECT section AS path, tag, CASE tag WHEN 'DA' THEN string_split(x[4:], ',')[1] WHEN 'FNDA' THEN regexp_replace(x[6:], '^[^,]*,', '') ELSE regexp_replace(x[6:], ',[^,]*$', '') END AS key,
  TRY_CAST(CASE tag WHEN 'DA' THEN string_split(x[4:], ',')[2] WHEN 'FNDA' THEN string_split(x[6:], ',')[1] ELSE regexp_extract(x, ',([^,]*)$', 1) END AS HUGEINT) AS value FROM w WHERE tag IN ('DA', 'FNDA', 'BRDA')
 UNION ALL SELECT section, unnest(['FN', 'group']), x[4:], NULL FROM w WHERE tag = 'FN' UNION ALL SELECT section, 'SF', '', NULL FROM w WHERE tag IN ('SF', 'KF') UNION ALL SELECT coming, 'TN', x[4:], NULL FROM w WHERE tag = 'TN' AND x <> 'TN:'),
m AS (SELECT path, tag, key, sum(value) AS value FROM r GROUP BY ALL),
s AS (SELECT 'shards' AS side, tag, value FROM r UNION ALL SELECT 'rendered', tag, value FROM m WHERE tag <> 'TN' UNION ALL SELECT 'rendered', 'TN', NULL FROM m WHERE tag = 'TN' GROUP BY path HAVING count(*) = 1)
SELECT side, CASE WHEN tag = 'BRDA' AND value IS NULL THEN 'BRDA-' ELSE tag END AS tag, count(*) AS n, CAST(CAST(sum(value) AS HUGEINT) AS VARCHAR) AS hits FROM s GROUP BY 1, 2"""


def _paths(spark, d):
    return _sql(spark, d, PATHS, "documents")


@query("SELECT doc_id, regexp_replace(path, '^/old/tree(/|$)', '/new/') AS path FROM paths")
def path_rebase(spark, d):
    return paths.apply_rules(_paths(spark, d), "path", paths.PathRules((("/old/tree", "/new"),)))


@query("SELECT doc_id, regexp_replace(path, '^/old/tree/hub[/]+', '') AS path FROM paths")
def path_strip(spark, d):
    return paths.apply_rules(_paths(spark, d), "path", paths.PathRules(strip="/old/tree/hub"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '../' ELSE '/' END || 'old/f_' || doc_id % 20 || '.c' AS path FROM documents")
def path_normalize(spark, d):
    raw = F.expr("concat(CASE doc_id % 3 WHEN 0 THEN '..\\\\' WHEN 1 THEN '/' ELSE '/../' END, 'old/.//tree/', coalesce(nullif(replace(source, '/', ''), ''), 'none'), '\\\\../../f_', doc_id % 20, '.c')")
    return table(spark, d, "documents").select("doc_id", paths.normalized(raw).alias("path"))


@query()
def parse_counters(spark, d):
    shards = table(spark, d, "shards")
    inputs = shards.select("input_id", F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint").alias("bytes"))
    return native.parse_counters(records_from_table(shards), inputs)


ORACLE["parse_counters"] = r"""WITH l AS (SELECT input_id, unnest(string_split(replace(body, chr(13), ''), chr(10))) AS x FROM shards), n AS (SELECT input_id, sum(CASE WHEN regexp_matches(x, '^(SF|KF|FN):') THEN 2 WHEN regexp_matches(x, '^(DA|FNDA|BRDA):') THEN 1 ELSE 0 END)::BIGINT AS records FROM l GROUP BY 1)
 SELECT s.input_id, strlen(coalesce(body, ''))::BIGINT AS bytes, coalesce(records, 0) AS records, 0::BIGINT AS errors FROM shards s LEFT JOIN n USING (input_id)"""


@query("SELECT doc_id, path FROM paths WHERE regexp_matches(path, '/hub/.*_1.?[.]c$') AND NOT regexp_matches(path, 'lab-[0-4]')")
def path_glob(spark, d):
    return paths.apply_rules(_paths(spark, d), "path", paths.PathRules(includes=("*/hub/*_1.c", "*/hub/*_1?.c"), excludes=("*lab-[0-4]*",)))


@query(r"""SELECT CASE WHEN x[1:3] = 'KF:' THEN 'SF' ELSE string_split(x, ':')[1] END AS tag, count(*) AS n FROM (SELECT unnest(string_split(replace(body, chr(13), ''), chr(10))) AS x FROM shards)
 WHERE regexp_matches(x, '^(DA|SF|KF):') GROUP BY 1""")
def family_filter(spark, d):
    """Records of ``shards`` read without functions and branches."""
    records = records_from_table(table(spark, d, "shards"), functions=False, branches=False).filter("kind IS NOT NULL AND kind <> 1")
    return records.groupBy(F.element_at(F.create_map(*[F.lit(x) for pair in _TAGS.items() for x in pair]), F.col("kind").cast("int")).alias("tag")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, first_value(declared IGNORE NULLS) OVER w AS current FROM sym WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def asof_declaration(spark, d):
    return op.first_declaration(_sql(spark, d, SYMBOLS, "events"), ["user_id"], "event_id", "declared").select("event_id", "current")


@query("SELECT f.source, f.start, f.stop, f.name, f.input_id, f.hits, (SELECT min(line) FROM cov_da l WHERE l.source = f.source AND l.count > 0 AND l.line BETWEEN f.start AND f.stop) AS first_hit FROM cov_fn f")
def range_first_hit(spark, d):
    return op.first_hit_in_range(lines(spark, d), functions(spark, d), ["source"], "line", "count", "start", "stop")


@query("SELECT source, start, name, first_hit, (hits > 0) = (first_hit IS NOT NULL) AS agrees FROM (SELECT f.*, (SELECT min(line) FROM cov_da l WHERE l.source = f.source AND l.count > 0 AND l.line BETWEEN f.start AND f.stop) AS first_hit FROM cov_fn f)")
def function_line_check(spark, d):
    checked = op.first_hit_in_range(lines(spark, d), functions(spark, d), ["source"], "line", "count", "start", "stop")
    return op.function_line_state(checked.withColumn("hit", F.col("hits") > 0), "hit").select("source", "start", "name", "first_hit", "agrees")


@query("""SELECT s.source, s.start, (SELECT max(line) FROM cov_da l WHERE l.source = s.source AND l.line >= s.start AND (s.next_start IS NULL OR l.line < s.next_start)) AS derived_end, next_start
 FROM (SELECT source, start, lead(start) OVER (PARTITION BY source ORDER BY start) AS next_start FROM (SELECT DISTINCT source, start FROM cov_fn)) s""")
def derive_end(spark, d):
    return op.derived_ends(functions(spark, d), lines(spark, d), ["source"], "start", "line")


@query("SELECT source, testcase, line, kind, hits FROM cov_br b WHERE EXISTS (SELECT 1 FROM cov_da l WHERE l.source = b.source AND l.input_id = b.input_id AND l.line = b.line)")
def eligible_semi(spark, d):
    return op.having(branches(spark, d), lines(spark, d), ["source", "input_id", "line"]).select("source", "testcase", "line", "kind", "hits")


@query("SELECT source, testcase, line, kind, hits FROM cov_br b WHERE NOT EXISTS (SELECT 1 FROM cov_da l WHERE l.source = b.source AND l.input_id = b.input_id AND l.testcase = b.testcase AND l.line = b.line)")
def ghost_anti(spark, d):
    return op.lacking(branches(spark, d), lines(spark, d), ["source", "input_id", "testcase", "line"]).select("source", "testcase", "line", "kind", "hits")


@query("SELECT source, input_id, count(DISTINCT testcase) > 1 AS multiple FROM cov_da GROUP BY ALL")
def input_eligibility(spark, d):
    return op.eligibility(lines(spark, d), ["source", "input_id"], "testcase")


_SYNTH = "SELECT source, input_id, line, count(*) FILTER (hits > 0) AS count FROM cov_mc c WHERE NOT EXISTS (SELECT 1 FROM cov_da l WHERE l.source = c.source AND l.input_id = c.input_id AND l.line = c.line) GROUP BY ALL"


@query(_SYNTH)
def synth_lines_anti(spark, d):
    return op.synthesized_lines(conditions(spark, d), lines(spark, d), ["source", "input_id", "line"], "hits")


@query(f"SELECT s.source, s.input_id, s.line, s.count, m.testcase FROM ({_SYNTH}) s JOIN (SELECT DISTINCT source, input_id, line, testcase FROM cov_mc) m USING (source, input_id, line)")
def project_members(spark, d):
    key = ["source", "input_id", "line"]
    c = conditions(spark, d)
    return op.members(op.synthesized_lines(c, lines(spark, d), key, "hits"), c, key, "testcase")


@query("SELECT source, arg_min(checksum, (input_id, section, line, checksum)) AS version, min(checksum) <> max(checksum) AS conflict FROM cov_da WHERE checksum IS NOT NULL GROUP BY source")
def version_first(spark, d):
    return op.first_by(lines(spark, d), ["source"], "checksum", ["input_id", "section", "line"]).withColumnRenamed("checksum", "version")


@query("SELECT source, line, input_id, section, count, checksum, first_value(checksum IGNORE NULLS) OVER (PARTITION BY source, line ORDER BY input_id, section, checksum ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS selected FROM cov_da")
def checksum_propagate(spark, d):
    return op.propagate_first(lines(spark, d), PLACE, "checksum", ["input_id", "section"]).select("source", "line", "input_id", "section", "count", "checksum", "selected")


_BLOCK = "source, testcase, line, input_id, section, block"
_SIGS = f"SELECT {_BLOCK}, string_agg(CASE kind WHEN 'v' THEN 'b' ELSE kind END, '' ORDER BY ordinal, CASE kind WHEN 'v' THEN 'b' ELSE kind END) AS signature, count(*)::INTEGER AS size FROM cov_br GROUP BY {_BLOCK}"


@query(_SIGS)
def block_signature(spark, d):
    return op.block_signatures(branches(spark, d), _BLOCK.split(", "), "ordinal", "kind")


@query(f"SELECT signature, dense_rank() OVER (ORDER BY length(signature), signature)::INTEGER AS rank FROM (SELECT DISTINCT signature FROM ({_SIGS}))")
def signature_rank(spark, d):
    return op.signature_ranks(op.block_signatures(branches(spark, d), _BLOCK.split(", "), "ordinal", "kind"))


_OCC = f"SELECT *, (dense_rank() OVER (PARTITION BY source, testcase, line, input_id, section, signature ORDER BY block) - 1)::INTEGER AS occurrence FROM ({_SIGS})"


@query(_OCC)
def occurrence_rank(spark, d):
    return op.occurrences(op.block_signatures(branches(spark, d), _BLOCK.split(", "), "ordinal", "kind"), ["source", "testcase", "line", "input_id", "section"], "block")


@query(f"""SELECT source, testcase, line, (dense_rank() OVER (PARTITION BY source, testcase, line ORDER BY length(signature), signature, occurrence) - 1)::INTEGER AS block, position, hits, expr FROM (
 SELECT b.source, b.testcase, b.line, o.signature, o.occurrence, b.position, sum(hits)::BIGINT AS hits, arg_min(expr, (b.input_id, b.section, b.ordinal, expr)) AS expr
 FROM (SELECT *, (row_number() OVER (PARTITION BY {_BLOCK} ORDER BY ordinal, kind, expr, hits NULLS FIRST) - 1)::INTEGER AS position FROM cov_br) b JOIN ({_OCC}) o USING ({_BLOCK}) GROUP BY ALL)""")
def branch_canonical(spark, d):
    rows = op.canonical_branches(branches(spark, d), ["input_id", "section"], ["source", "testcase", "line"], "block", "ordinal", "kind", "hits", "expr")
    return _whole(rows, "hits")


@query("SELECT DISTINCT source, line, block, (dense_rank() OVER (PARTITION BY source, line ORDER BY block) - 1)::INTEGER AS renumbered FROM cov_br")
def block_renumber(spark, d):
    return op.renumber(branches(spark, d).select(*PLACE, "block").distinct(), PLACE, ["block"], "renumbered")


@query("SELECT DISTINCT source, testcase, line, grp, idx, (dense_rank() OVER (PARTITION BY source, testcase, line, grp ORDER BY idx) - 1)::INTEGER AS renumbered FROM cov_mc")
def mcdc_renumber(spark, d):
    return op.renumber(conditions(spark, d).select("source", "testcase", "line", "grp", "idx").distinct(), ["source", "testcase", "line", "grp"], ["idx"], "renumbered")


@query("""SELECT k.source, k.line, k.grp, k.idx, s.sense, coalesce(m.hits, 0)::BIGINT AS hits, m.hits IS NULL AS added FROM (SELECT DISTINCT source, line, grp, idx FROM cov_mc) k, (VALUES ('t'), ('f')) s(sense)
 LEFT JOIN (SELECT source, line, grp, idx, sense, sum(hits) AS hits FROM cov_mc GROUP BY ALL) m ON m.source = k.source AND m.line = k.line AND m.grp = k.grp AND m.idx = k.idx AND m.sense = s.sense""")
def mcdc_complete_sense(spark, d):
    return _whole(op.complete_senses(conditions(spark, d), [*PLACE, "grp", "idx"], "sense", "hits"), "hits")


@query("""SELECT p.source, p.input_id, p.line, p.hit_points, CASE WHEN l.n IS NULL THEN 'no line' WHEN l.n = 0 AND hit_points > 0 THEN 'hit branch on unhit line' WHEN l.n > 0 AND hit_points = 0 THEN 'hit line without hit branch' ELSE 'ok' END AS state,
 CASE WHEN l.n IS NULL THEN hit_points END AS repaired FROM (SELECT source, input_id, line, count(*) FILTER (hits > 0) AS hit_points FROM cov_br GROUP BY ALL) p LEFT JOIN (SELECT source, input_id, line, sum(count) AS n FROM cov_da GROUP BY ALL) l USING (source, input_id, line)""")
def branch_line_check(spark, d):
    return op.branch_line_state(lines(spark, d), branches(spark, d), ["source", "input_id", "line"], "count", "hits")


@query("""SELECT source, line, a.n AS value_a, b.n AS value_b FROM (SELECT source, line, sum(count)::BIGINT AS n FROM cov_da WHERE input_id = 0 GROUP BY ALL) a
 FULL JOIN (SELECT source, line, sum(count)::BIGINT AS n FROM cov_da WHERE input_id = 1 GROUP BY ALL) b USING (source, line) WHERE a.n IS DISTINCT FROM b.n""")
def tracefile_diff(spark, d):
    rows = lines(spark, d)
    a, b = (_whole(op.merge_counts(rows.filter(F.col("input_id") == k), PLACE), "count") for k in (0, 1))
    return op.difference(a, b, PLACE, "count")


@query("SELECT input_no, source, sum(count)::BIGINT AS count FROM (SELECT 0 AS input_no, source, count FROM cov_da UNION ALL SELECT 1, source, hits FROM cov_fn) GROUP BY ALL")
def union_inputs(spark, d):
    parts = lines(spark, d).select("source", "count"), functions(spark, d).select("source", F.col("hits").alias("count"))
    return _whole(op.merge_counts(op.union_inputs(*parts), ["input_no", "source"]), "count")


@query("SELECT source, line, 2 * sum(count)::BIGINT AS count FROM cov_da GROUP BY ALL")
def duplicate_input(spark, d):
    rows = lines(spark, d)
    return _whole(op.merge_counts(op.union_inputs(rows, rows), PLACE), "count")


@query("SELECT doc_id, rtrim(base64(unhex(md5(regexp_replace(text, '[\\r\\n]+$', '')))), '=') AS digest FROM documents")
def md5_checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", numbers.line_digest(F.col("text")).alias("digest"))


@query("""SELECT DISTINCT tn, regexp_replace(string_split(tn, ',')[1], '[^A-Za-z0-9_]', '_', 'g') || CASE WHEN regexp_matches(tn, '^[^,]*,diff') THEN ',diff' ELSE '' END AS clean FROM records WHERE tn IS NOT NULL""")
def testcase_normalize(spark, d):
    return table(spark, d, "records").filter("tn IS NOT NULL").select("tn").distinct().select("tn", numbers.normalized_testcase(F.col("tn")).alias("clean"))


@query(r"""SELECT row_id, hits, CASE WHEN regexp_full_match(hits, '[+]?[0-9]+') THEN CASE WHEN length(digits) > 19 THEN 9223372036854775807 ELSE least(CAST(digits AS HUGEINT), 9223372036854775807)::BIGINT END
 WHEN isfinite(number) THEN CASE WHEN number >= 9223372036854775808::DOUBLE THEN 9223372036854775807 ELSE CAST(greatest(trunc(number), 0) AS BIGINT) END END AS value
 FROM (SELECT row_id, hits, CASE WHEN regexp_full_match(hits, '[+]?[0-9]+') THEN regexp_replace(ltrim(hits, '+'), '^0+([0-9])', '\1') END AS digits,
  CASE WHEN regexp_full_match(hits, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(hits AS DOUBLE) END AS number FROM (SELECT row_id, string_split(raw, ',')[6] AS hits FROM branch_rows)) WHERE hits IS NOT NULL""")
def parse_count(spark, d):
    """The lenient count of every sixth field, of any length and exponent."""
    rows = table(spark, d, "branch_rows").select("row_id", F.get(F.split("raw", ","), F.lit(5)).alias("hits")).filter("hits IS NOT NULL")
    return rows.select("row_id", "hits", numbers.lenient_count(F.col("hits"))["value"].cast("bigint").alias("value"))


@query("SELECT event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before > value")
def order_check(spark, d):
    return op.out_of_order(table(spark, d, "events"), ["user_id"], "event_id", "value").select("event_id")


def compat_lines(spark, d):
    """Lines of the testcase-preserving merge of the tracefiles in ``shards``."""
    plan = CompatMerge(spark, table(spark, d, "shards"), Options(functions=False, keep_going=True))
    return plan.lines.select("source", "testcase", F.col("line").cast("bigint").alias("line"), F.col("count").cast("bigint").alias("count"))


def compat_render(spark, d):
    """The whole testcase-preserving merge of ``shards``, as ordered lines."""
    return CompatMerge(spark, table(spark, d, "shards"), Options(branches=True, keep_going=True)).ordered()


QUERIES |= {f.__name__: f for f in (compat_lines, compat_render)}
ORACLE["compat_lines"] = r"""WITH parts AS (SELECT input_id, unnest(string_split(chr(10) || replace(body, chr(13), ''), chr(10) || 'TN:')) AS part FROM shards),
l AS (SELECT regexp_extract(part, '^([^
]*)
', 1) AS testcase, regexp_extract(part, '
[SK]F:([^
]*)
', 1) AS source, unnest(string_split(part, chr(10))) AS x FROM parts)
SELECT source, testcase, CAST(string_split(x[4:], ',')[1] AS BIGINT) AS line, sum(CAST(string_split(x[4:], ',')[2] AS BIGINT))::BIGINT AS count FROM l WHERE x[1:3] = 'DA:' GROUP BY ALL"""


# -- the testcase-preserving merge, stage by stage, on tracefiles written from the star schema -------------------------------

_PLACE = "concat('/src/pkg', l_suppkey % 4, '/file_', l_partkey % 50, '.c') AS source, l_returnflag AS testcase, CAST(l_orderkey % 97 AS BIGINT) AS input_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS k1, CAST(l_partkey AS BIGINT) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS k2"
FILES = {
    "DA": f"SELECT {_PLACE}, CAST(l_linenumber + 7 * (l_orderkey % 9) AS BIGINT) AS line, CASE WHEN l_discount < 0.03 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS count FROM lineitem WHERE l_returnflag <> 'R' OR l_orderkey % 7 < 5",
    "BRDA": f"SELECT {_PLACE}, CAST(l_linenumber + 7 * (l_orderkey % 13) AS BIGINT) AS line, CAST(l_suppkey % 3 AS BIGINT) AS block, CASE l_partkey % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'e' ELSE 'f' END AS kind, l_partkey % 9 = 0 AS unreachable,"
            " CASE WHEN l_tax < 0.02 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 5 END AS hits, concat('x', l_partkey % 10) AS name FROM lineitem WHERE l_orderkey % 3 = 0",
    "MCDC": f"SELECT {_PLACE}, CAST(l_linenumber + 7 * (l_orderkey % 12) AS BIGINT) AS line, CAST(1 + l_suppkey % 2 AS BIGINT) AS block, CAST(2 * (l_partkey % 5) AS BIGINT) AS idx, CASE WHEN l_tax < 0.05 THEN 't' ELSE 'f' END AS kind, l_partkey % 11 = 0 AS unreachable,"
            " CAST(l_quantity AS BIGINT) % 3 AS hits, concat('c', l_partkey % 5, CASE WHEN l_tax > 0.07 THEN '!' ELSE '' END) AS name FROM lineitem WHERE l_orderkey % 3 = 1",
    "FN": "SELECT concat('/src/pkg', p_partkey % 4, '/file_', p_partkey % 50, '.c') AS source, CASE WHEN p_partkey % 5 = 0 THEN 'N' ELSE 'A' END AS testcase, CAST(p_partkey % 97 AS BIGINT) AS input_id, CAST(p_partkey AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2,"
          " CAST(p_size AS BIGINT) AS line, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size + p_partkey % 6 AS BIGINT) END AS stop, concat('fn_', p_partkey % 7) AS name, CAST(floor(p_retailprice) AS BIGINT) % 4 AS hits FROM part",
}
FILES["VER"] = ("SELECT concat('/src/pkg', l_suppkey % 4, '/file_', l_partkey % 50, '.c') AS source, l_returnflag AS testcase, CAST(l_orderkey % 97 AS BIGINT) AS input_id, CAST(max(l_orderkey) AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2,"
                " concat('v', max(l_orderkey) % 3) AS name FROM lineitem GROUP BY 1, 2, 3")
_TEXTS = {
    "VER": "concat('VER:', name)",
    "FN": "concat('FN:', line, ',', CASE WHEN stop IS NULL THEN '' ELSE concat(stop, ',') END, name, '\\nFNDA:', hits, ',', name)",
    "BRDA": "concat('BRDA:', line, ',', CASE kind WHEN 'v' THEN '' ELSE kind END, CASE WHEN unreachable THEN 'U' ELSE '' END, block, ',', name, ',', coalesce(CAST(hits AS STRING), '-'))",
    "MCDC": "concat('MCDC:', line, ',', CASE WHEN unreachable THEN 'U' ELSE '' END, block, ',', kind, ',', hits, ',', idx, ',', name)",
    "DA": "concat('DA:', line, ',', count)",
}


def tracefiles(spark, d) -> DataFrame:
    """input_id, body: tracefiles with one section per source and testcase, written from the star schema."""
    parts = [_sql(spark, d, f"SELECT input_id, source, testcase, {k} AS part, k1, k2, {_TEXTS[tag]} AS text FROM ({FILES[tag]})", "lineitem", "part") for k, tag in enumerate(_TEXTS)]
    rows = functools.reduce(DataFrame.unionByName, parts)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k1", "k2", "text"))), lambda x: x["text"]), "\n")
    sections = rows.groupBy("input_id", "source", "testcase").agg(F.concat(F.lit("TN:"), "testcase", F.lit("\nSF:"), "source", F.lit("\n"), lines, F.lit("\nend_of_record\n")).alias("text"))
    return sections.groupBy("input_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "testcase", "text"))), lambda x: x["text"]), "").alias("body"))


def _compat(spark, d, **families) -> CompatMerge:
    return CompatMerge(spark, tracefiles(spark, d), Options(**({"functions": False} | families), keep_going=True))


_CTX = ", ".join(f"c_{tag.lower()} AS ({sql})" for tag, sql in FILES.items()) + """, has_da AS (SELECT DISTINCT source, input_id, testcase FROM c_da), alive AS (SELECT DISTINCT source, input_id FROM c_da)"""
_CTX_MC = """, mc AS (SELECT m.* FROM c_mcdc m SEMI JOIN alive USING (source, input_id)), mc_public AS (SELECT m.* FROM mc m SEMI JOIN has_da USING (source, input_id, testcase)),
mc_first AS (SELECT source, input_id, line, block, idx, arg_min(name, (testcase, k1, k2)) AS name FROM mc GROUP BY ALL),
mc_points AS (SELECT m.source, m.input_id, m.line, m.block, m.idx, m.kind, bool_or(m.unreachable) AS unreachable, sum(m.hits) AS hits FROM mc m JOIN mc_first f USING (source, input_id, line, block, idx, name) GROUP BY ALL),
mc_lines AS (SELECT p.source, p.input_id, p.line, count(*) FILTER (NOT unreachable AND hits > 0) AS count FROM mc_points p ANTI JOIN c_da d ON d.source = p.source AND d.input_id = p.input_id AND d.line = p.line GROUP BY ALL)"""
_CTX_BR = """, br AS (SELECT b.* FROM c_brda b SEMI JOIN alive USING (source, input_id)),
br_blocks AS (SELECT source, testcase, input_id, line, block, string_agg(CASE kind WHEN 'v' THEN 'b' ELSE kind END, '' ORDER BY k1, k2) AS signature FROM br GROUP BY ALL),
br_ranked AS (SELECT *, dense_rank() OVER (PARTITION BY source, testcase, input_id, line, signature ORDER BY block) - 1 AS occurrence FROM br_blocks),
br_placed AS (SELECT b.*, r.signature, r.occurrence, row_number() OVER (PARTITION BY source, testcase, input_id, line, block ORDER BY k1, k2) - 1 AS position FROM br b JOIN br_ranked r USING (source, testcase, input_id, line, block)),
br_points AS (SELECT source, input_id, line, signature, occurrence, position, max(hits) AS hits FROM br_placed GROUP BY ALL), br_hit AS (SELECT source, input_id, line, count(*) FILTER (hits > 0) AS hit_points FROM br_points GROUP BY ALL),
present AS (SELECT source, input_id, line FROM c_da UNION SELECT source, input_id, line FROM mc_lines),
repaired AS (SELECT h.source, h.input_id, h.line, h.hit_points AS count, t.testcases, t.testcase FROM br_hit h JOIN (SELECT source, input_id, line, count(DISTINCT testcase) AS testcases, min(testcase) AS testcase FROM br_placed GROUP BY ALL) t USING (source, input_id, line)
  ANTI JOIN present p ON p.source = h.source AND p.input_id = h.input_id AND p.line = h.line)"""


def _stage(sql: str, *contexts: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"WITH {_CTX}{''.join(contexts)} {sql}"
        return f

    return register


@_stage("""SELECT source, testcase, line, block, dense_rank() OVER (PARTITION BY source, testcase, line, block ORDER BY old)::INTEGER - 1 AS idx, kind, hits, unreachable, name FROM (
 SELECT k.source, k.testcase, k.line, k.block, k.idx AS old, s.kind, coalesce(m.hits, 0)::BIGINT AS hits, coalesce(m.unreachable, false) AS unreachable, k.name FROM (SELECT source, testcase, line, block, idx, arg_min(name, (input_id, k1, k2)) AS name FROM mc_public GROUP BY ALL) k, (VALUES ('t'), ('f')) s(kind)
 LEFT JOIN (SELECT source, testcase, line, block, idx, name, kind, sum(hits) AS hits, bool_or(unreachable) AS unreachable FROM mc_public GROUP BY ALL) m
  ON m.source = k.source AND m.testcase = k.testcase AND m.line = k.line AND m.block = k.block AND m.idx = k.idx AND m.name = k.name AND m.kind = s.kind)""", _CTX_MC)
def compat_conditions(spark, d):
    """Conditions of every testcase with lines: first expression, both senses, renumbered."""
    return _whole(_compat(spark, d, mcdc=True).conditions, "line", "block", "hits").select("source", "testcase", "line", "block", "idx", "kind", "hits", "unreachable", "name")


@_stage("""SELECT source, testcase, line, (dense_rank() OVER (PARTITION BY source, testcase, line ORDER BY length(signature), signature, occurrence) - 1)::INTEGER AS block, position::INTEGER AS position, hits, unreachable, kind, name FROM (
 SELECT source, testcase, line, signature, occurrence, position, sum(hits)::BIGINT AS hits, bool_or(unreachable) AS unreachable, arg_min(kind, (input_id, k1, k2)) AS kind, arg_min(name, (input_id, k1, k2)) AS name
 FROM (SELECT b.* FROM br_placed b SEMI JOIN has_da USING (source, input_id, testcase)) GROUP BY ALL)""", _CTX_MC, _CTX_BR)
def compat_branches(spark, d):
    """Branches of every testcase with lines, matched by the signatures of their blocks."""
    return _whole(_compat(spark, d, branches=True).branches, "line", "hits").select("source", "testcase", "line", "block", "position", "hits", "unreachable", "kind", "name")


@_stage("""SELECT source, testcase, line, sum(count)::BIGINT AS count FROM (SELECT source, testcase, line, count FROM c_da
 UNION ALL SELECT l.source, m.testcase, l.line, l.count FROM mc_lines l JOIN (SELECT DISTINCT source, input_id, line, testcase FROM mc_public) m USING (source, input_id, line)
 UNION ALL SELECT r.source, r.testcase, r.line, r.count FROM repaired r SEMI JOIN has_da USING (source, input_id, testcase) WHERE r.testcases = 1) GROUP BY ALL""", _CTX_MC, _CTX_BR)
def compat_repaired_lines(spark, d):
    """Lines of the merge with those made up for conditions and for branches without a line."""
    return _whole(_compat(spark, d, branches=True, mcdc=True).lines, "line", "count").select("source", "testcase", "line", "count")


@_stage("""SELECT source, input_id, line, CASE WHEN n IS NULL THEN 'no line' WHEN n = 0 AND hit_points > 0 THEN 'hit branch on unhit line' WHEN n > 0 AND hit_points = 0 THEN 'hit line without hit branch' ELSE 'ok' END AS state, hit_points
 FROM br_hit LEFT JOIN (SELECT source, input_id, line, sum(count) AS n FROM (SELECT source, input_id, line, count FROM c_da UNION ALL SELECT * FROM mc_lines) GROUP BY ALL) USING (source, input_id, line)""", _CTX_MC, _CTX_BR)
def compat_branch_lines(spark, d):
    """How the branches of a line in an input agree with its count."""
    return _whole(_compat(spark, d, branches=True, mcdc=True).branch_states, "line").select("source", "input_id", "line", "state", "hit_points")


_CTX_FN = """, fn_named AS (SELECT source, input_id, testcase, name, arg_min(line, k1) AS line, arg_min({'s': stop}, k1).s AS stop, sum(hits)::BIGINT AS hits FROM c_fn SEMI JOIN alive USING (source, input_id) GROUP BY ALL),
fn_groups AS (SELECT source, input_id, line, bool_or(hits > 0) AS hit, max(stop) AS stop FROM fn_named GROUP BY ALL), da AS (SELECT source, input_id, line, sum(count) AS count FROM c_da GROUP BY ALL), last AS (SELECT source, input_id, max(line) AS last_line FROM c_da GROUP BY ALL),
fn_next AS (SELECT *, lead(line) OVER (PARTITION BY source, input_id ORDER BY line) AS next FROM fn_groups),
fn_ended AS (SELECT g.source, g.input_id, g.line, g.hit, coalesce(g.stop, (SELECT max(d.line) FROM da d WHERE d.source = g.source AND d.input_id = g.input_id AND d.line >= g.line AND (g.next IS NULL OR d.line < g.next))) AS stop FROM fn_next g),
fn_seen AS (SELECT e.*, l.last_line, CASE WHEN e.stop >= e.line AND l.last_line >= e.line THEN (SELECT min(d.line) FROM da d WHERE d.source = e.source AND d.input_id = e.input_id AND d.count > 0 AND d.line BETWEEN e.line AND e.stop) END AS first_hit FROM fn_ended e JOIN last l USING (source, input_id)),
fn_fixed AS (SELECT s.*, CASE WHEN NOT s.hit AND first_hit IS NOT NULL THEN (SELECT d.count FROM da d WHERE d.source = s.source AND d.input_id = s.input_id AND d.line = s.first_hit) ELSE 0 END AS addition FROM fn_seen s),
fn_input AS (SELECT n.source, n.input_id, n.testcase, n.name, n.line, coalesce(f.stop, n.stop) AS stop, (n.hits + f.addition)::BIGINT AS hits FROM fn_named n JOIN fn_fixed f USING (source, input_id, line))"""


@_stage("SELECT * FROM fn_input", _CTX_FN)
def compat_functions(spark, d):
    """Functions of every input: hits at their first declaration, ends derived, hits corrected by the lines."""
    return _whole(_compat(spark, d, functions=True).functions, "line", "stop", "hits").select("source", "input_id", "testcase", "name", "line", "stop", "hits")


@_stage("""SELECT source, testcase, name, line, stop, hits, (dense_rank() OVER (PARTITION BY source, testcase ORDER BY line, alias, stop NULLS FIRST) - 1)::INTEGER AS idx FROM (
 SELECT *, min(name) OVER (PARTITION BY source, testcase, line) AS alias FROM fn_final)""", _CTX_FN, """, fn_public AS (SELECT f.* FROM fn_input f SEMI JOIN has_da USING (source, input_id, testcase)),
fn_merged AS (SELECT source, testcase, name, arg_min(line, (input_id, line, coalesce(stop, -1))) AS line, arg_min({'s': stop}, (input_id, line, coalesce(stop, -1))).s AS stop, sum(hits) AS hits FROM fn_public GROUP BY ALL),
fn_unified AS (SELECT source, testcase, name, line, max(stop) OVER (PARTITION BY source, testcase, line) AS stop, hits FROM fn_merged),
all_lines AS (SELECT source, line, sum(count) AS count FROM c_da GROUP BY ALL), all_last AS (SELECT source, max(line) AS last_line FROM c_da GROUP BY ALL),
everyone AS (SELECT source, line, stop, hits FROM fn_unified UNION ALL SELECT f.source, f.line, f.stop, f.hits FROM fn_input f ANTI JOIN has_da h ON h.source = f.source AND h.input_id = f.input_id AND h.testcase = f.testcase),
every_group AS (SELECT source, line, bool_or(hits > 0) AS hit, max(stop) AS stop FROM everyone GROUP BY ALL),
every_seen AS (SELECT g.*, CASE WHEN g.stop >= g.line AND l.last_line >= g.line THEN (SELECT min(d.line) FROM all_lines d WHERE d.source = g.source AND d.count > 0 AND d.line BETWEEN g.line AND g.stop) END AS first_hit FROM every_group g JOIN all_last l USING (source)),
additions AS (SELECT s.source, s.line, d.count AS addition FROM every_seen s JOIN all_lines d ON d.source = s.source AND d.line = s.first_hit WHERE NOT s.hit),
fn_added AS (SELECT u.source, u.testcase, u.name, u.line, u.stop, (u.hits + coalesce(a.addition, 0))::BIGINT AS hits FROM fn_unified u LEFT JOIN additions a USING (source, line)),
fn_starts AS (SELECT *, lead(line) OVER (PARTITION BY source, testcase ORDER BY line) AS next FROM (SELECT DISTINCT source, testcase, line FROM fn_added)),
fn_final AS (SELECT f.source, f.testcase, f.name, f.line, coalesce(f.stop, (SELECT max(d.line) FROM c_da d WHERE d.source = f.source AND d.testcase = f.testcase AND d.line >= f.line AND (s.next IS NULL OR d.line < s.next))) AS stop, f.hits
  FROM fn_added f JOIN fn_starts s USING (source, testcase, line))""")
def compat_final_functions(spark, d):
    """Functions of every testcase merged over the inputs, corrected by all lines and renumbered."""
    return _whole(_compat(spark, d, functions=True).final_functions, "line", "stop", "hits").select("source", "testcase", "name", "line", "stop", "hits", "idx")


@_stage("SELECT source, arg_min(name, (input_id, testcase)) AS name, min(name) <> max(name) AS conflict FROM c_ver SEMI JOIN alive USING (source, input_id) GROUP BY source")
def compat_versions(spark, d):
    """The version of every source: the first one, and whether others occur."""
    return _compat(spark, d).versions.select("source", "name", "conflict")


_FINAL = {name: ORACLE[name][ORACLE[name].rindex(start):] for name, start in (("compat_branches", "SELECT source, testcase, line, (dense_rank()"), ("compat_conditions", "SELECT source, testcase, line, block, dense_rank()"), ("compat_repaired_lines", "SELECT source, testcase, line, sum(count)"))}


@_stage(f"""SELECT source, testcase, rank::INTEGER AS rank, line FROM (
 SELECT DISTINCT source, testcase, 0 AS rank, 'TN:' || testcase || chr(10) || 'SF:' || source AS line FROM ln UNION ALL SELECT DISTINCT source, testcase, 1, 'VER:' || name FROM ln JOIN (SELECT source, arg_min(name, (input_id, testcase)) AS name FROM c_ver SEMI JOIN alive USING (source, input_id) GROUP BY source) USING (source)
 UNION ALL SELECT source, testcase, 4, concat('BRDA:', line, ',', CASE kind WHEN 'v' THEN '' ELSE kind END, CASE WHEN unreachable THEN 'U' ELSE '' END, block, ',', name, ',', coalesce(hits::VARCHAR, '-')) FROM bf
 UNION ALL SELECT source, testcase, 5, concat('BRF:', count(*), chr(10), 'BRH:', count(*) FILTER (hits > 0)) FROM bf WHERE NOT unreachable GROUP BY source, testcase
 UNION ALL SELECT source, testcase, 6, concat('MCDC:', line, ',', CASE WHEN unreachable THEN 'U' ELSE '' END, block, ',', kind, ',', hits, ',', idx, ',', name) FROM cf
 UNION ALL SELECT source, testcase, 7, concat('MCF:', count(*), chr(10), 'MCH:', count(*) FILTER (hits > 0)) FROM cf GROUP BY source, testcase
 UNION ALL SELECT source, testcase, 8, concat('DA:', line, ',', count) FROM ln
 UNION ALL SELECT source, testcase, 9, concat('LF:', count(*), chr(10), 'LH:', count(*) FILTER (count > 0), chr(10), 'end_of_record') FROM ln GROUP BY source, testcase)""", _CTX_MC, _CTX_BR,
        f", ln AS ({_FINAL['compat_repaired_lines']}), bf AS ({_FINAL['compat_branches']}), cf AS ({_FINAL['compat_conditions']})")
def compat_texts(spark, d):
    """The lines of the merged tracefile with branches and conditions, by section."""
    return _compat(spark, d, branches=True, mcdc=True).rendered().select("source", "testcase", "rank", "line")
