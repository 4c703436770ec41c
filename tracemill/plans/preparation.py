"""Registered queries of the general data-preparation operators, and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import copydiff, drift, heavy, rejects
from tracemill.session import table
from tracemill.streaming import compactor

MEASURES = ("fnf", "fnh", "lf", "lh", "brf", "brh", "mcf", "mch")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_delimited(table(spark, d, "branch_rows")).filter("reason IS NOT NULL").select("row_id", "reason")


def p1_branch_records(spark: SparkSession, d: str) -> DataFrame:
    """The valid branch rows with all their fields; ``hits`` is null for ``-``."""
    good = rejects.parse_delimited(table(spark, d, "branch_rows")).filter("reason IS NULL")
    numbers = {c: F.col(c).cast("string") for c in ("line_no", "line", "block", "hits")}
    return good.withColumns(numbers).withColumn("no_hits", F.col("hits").isNull()).select("row_id", "line_no", "line", "block", "kind", "unreachable", "hits", "no_hits", "expression")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_delimited(table(spark, d, "branch_rows")).groupBy(F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n"))


def _compacted(spark: SparkSession, d: str) -> compactor.Compactor:
    return compactor.compact_table(spark, table(spark, d, "shards"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return compactor.shared_pairs(_compacted(spark, d).members())


def p2_sections(spark: SparkSession, d: str) -> DataFrame:
    """The compacted sections themselves, each once."""
    return _compacted(spark, d).sections().select("tn", "path", F.array_join("rows", "\n").alias("body"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Inputs with sections: their class of identical inputs, and with how many others they share a section."""
    return compactor.linked_inputs(_compacted(spark, d).members())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    weighted = heavy.compress(table(spark, d, "records"), "path", "value")
    return heavy.with_ranges(heavy.heavy_keys(weighted), table(spark, d, "splitters")).select("plan_id", "range_no", F.col("key").alias("path"))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    result = heavy.profile(table(spark, d, "records"), "path", "value")
    whole = [F.col(c).cast("string").alias(c) for c in ("mode", "p50", "p90", "p99")]
    return result.select(F.col("key").alias("path"), "n_rows", "n_null", "n_distinct", *whole)


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """How many rows and paths each range of each plan holds."""
    keys = heavy.key_weights(heavy.compress(table(spark, d, "records"), "path", "kind")).filter("key IS NOT NULL")
    return heavy.with_ranges(keys, table(spark, d, "splitters")).groupBy("plan_id", "range_no").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_paths"))


def _differences(spark: SparkSession, d: str) -> DataFrame:
    return copydiff.copy_differences(table(spark, d, "totals_a"), table(spark, d, "totals_b"), ("build_id", "path"), MEASURES, "computed_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _differences(spark, d).select("build_id", "path", "field")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return _differences(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "section_rows")).select("feed_id", "file_seq", "field", "change")


def p5_lifespans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "section_rows")
    spans = drift.lifespans(drift.catalogue(rows), rows.select("feed_id", "file_seq"))
    return spans.select("feed_id", "field", "type", "first_seq", "last_seq", "files")


def p5_sections(spark: SparkSession, d: str) -> DataFrame:
    """One consistent table of all sections; fields beside the canonical ones as ``name=JSON`` in ``extra``."""
    rows = drift.consistent(table(spark, d, "section_rows"))
    extra = F.array_join(F.transform("extra", lambda e: F.concat(e["name"], F.lit("="), e["value"])), ";")
    return rows.withColumns({"lines": F.col("lines").cast("string"), "extra": extra})


QUERIES = {f.__name__: f for f in (
    p1_found, p1_branch_records, p1_reasons, p2_found, p2_sections, p2_classes, p3_found, p3_profile, p3_ranges, p4_found, p4_values, p5_found, p5_lifespans, p5_sections)}

_QUOTED = r'''"(?:[^"]|"")*"'''
_FIELD = rf'''(?:{_QUOTED}|[^",]*)'''
_GROUPS = ",".join(rf'''({_QUOTED}|[^",]*)''' for _ in range(7))
_P1 = rf"""
WITH raws AS (SELECT row_id, coalesce(raw, '') AS raw FROM branch_rows),
shape AS (SELECT row_id, raw, regexp_full_match(raw, '{_FIELD}(?:,{_FIELD})*') AS quoted_well,
  regexp_full_match(raw, '{_FIELD}(?:,{_FIELD}){{6}}') AND raw <> '' AS seven,
  regexp_extract(raw, '^{_GROUPS}$', ['f1', 'f2', 'f3', 'f4', 'f5', 'f6', 'f7']) AS f FROM raws),
bare AS (SELECT row_id, quoted_well, seven, {", ".join(f'''CASE WHEN f.f{i}[1] = '"' THEN replace(f.f{i}[2:length(f.f{i})-1], '""', '"') ELSE f.f{i} END AS f{i}''' for i in range(1, 8))} FROM shape),
ok AS (SELECT *, {", ".join(f"regexp_full_match(f{i}, '[0-9]+') AND length(ltrim(f{i}, '0')) <= 20 AND coalesce(TRY_CAST('0' || ltrim(f{i}, '0') AS HUGEINT) BETWEEN {least} AND 18446744073709551615, false) AS n{i}" for i, least in ((1, 1), (2, 1), (3, 0)))},
  f4 IN ('v', 'e', 'f') AND f5 IN ('0', '1') AND f7 <> '' AND (f6 = '-' OR (regexp_full_match(f6, '\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(f6 AS DOUBLE)), false))) AS rest FROM bare),
judged AS (SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN NOT seven THEN 'columns' WHEN NOT (n1 AND n2 AND n3 AND rest) THEN 'value' END AS reason FROM ok)
"""
_P2 = r"""
WITH lines AS (SELECT input_id, string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM shards),
kept AS (SELECT input_id, chr(10) || array_to_string(list_filter(ls, lambda x: x <> '' AND x[1] <> '#' AND NOT regexp_matches(x, '^(FNF|FNH|BRF|BRH|MCF|MCH|LF|LH):')), chr(10)) AS t FROM lines),
parts AS (SELECT input_id, unnest(string_split(regexp_replace(t, '\n(TN:[^\n]*\n)?(SF|KF):', chr(1) || '\1\2:', 'g'), chr(1))[2:]) AS part FROM kept),
own AS (SELECT input_id, string_split(regexp_replace(part, '(?s)\nend_of_record.*', ''), chr(10)) AS ls FROM parts),
sections AS (SELECT input_id, CASE WHEN ls[1][1:3] = 'TN:' THEN ls[1][4:] ELSE '' END AS tn, CASE WHEN ls[1][1:3] = 'TN:' THEN ls[2][4:] ELSE ls[1][4:] END AS path,
  array_to_string(list_sort(list_filter(ls, lambda x: NOT regexp_matches(x, '^(TN|SF|KF):'))), chr(10)) AS body FROM own)
"""
_LATEST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY build_id, path ORDER BY computed_at DESC) AS n FROM {t}) WHERE n = 1"
_P4_FIELDS = " UNION ALL ".join(f"SELECT build_id, path, '{m}' AS field, CAST(a.{m} AS VARCHAR) AS value_a, CAST(b.{m} AS VARCHAR) AS value_b FROM a JOIN b USING (build_id, path) WHERE a.{m} IS DISTINCT FROM b.{m}" for m in MEASURES)
_P4 = f"""
WITH a AS ({_LATEST.format(t='totals_a')}), b AS ({_LATEST.format(t='totals_b')}),
d AS (SELECT build_id, path, 'only_a' AS field, NULL::VARCHAR AS value_a, NULL::VARCHAR AS value_b FROM a ANTI JOIN b USING (build_id, path)
UNION ALL SELECT build_id, path, 'only_b', NULL, NULL FROM b ANTI JOIN a USING (build_id, path) UNION ALL {_P4_FIELDS})
"""
_P5 = """
WITH RECURSIVE once AS (SELECT DISTINCT feed_id, file_seq, row_no, body FROM section_rows),
vals AS (SELECT feed_id, file_seq, body ->> 'section_id' AS section, unnest(json_keys(body)) AS field, body FROM once),
typed AS (SELECT feed_id, file_seq, section, field, json_extract(body, '$."' || field || '"') AS v FROM vals),
kinds AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END AS type FROM typed),
cat AS (SELECT feed_id, file_seq, field, CASE WHEN bool_or(type = 'number') AND bool_or(type = 'integer') AND count(DISTINCT type) = 2 THEN 'number' ELSE string_agg(DISTINCT type, '|') END AS type FROM kinds GROUP BY ALL)
"""
_RENAMED = """, files AS (SELECT feed_id, file_seq, lag(file_seq) OVER (PARTITION BY feed_id ORDER BY file_seq) AS prev FROM (SELECT DISTINCT feed_id, file_seq FROM section_rows)),
moved AS (SELECT f.feed_id, f.file_seq, f.prev FROM files f WHERE f.prev IS NOT NULL),
coming AS (SELECT m.feed_id, m.file_seq, m.prev, c.field, c.type FROM moved m JOIN cat c ON c.feed_id = m.feed_id AND c.file_seq = m.file_seq ANTI JOIN cat o ON o.feed_id = m.feed_id AND o.file_seq = m.prev AND o.field = c.field),
going AS (SELECT m.feed_id, m.file_seq, m.prev, c.field, c.type FROM moved m JOIN cat c ON c.feed_id = m.feed_id AND c.file_seq = m.prev ANTI JOIN cat o ON o.feed_id = m.feed_id AND o.file_seq = m.file_seq AND o.field = c.field),
fits AS (SELECT n.feed_id, n.file_seq, n.field AS new, g.field AS old, count(*) AS agree FROM coming n JOIN going g ON g.feed_id = n.feed_id AND g.file_seq = n.file_seq AND g.type = n.type
  JOIN kinds x ON x.feed_id = n.feed_id AND x.file_seq = n.file_seq AND x.field = n.field AND x.type IS NOT NULL
  JOIN kinds y ON y.feed_id = n.feed_id AND y.file_seq = n.prev AND y.field = g.field AND y.type IS NOT NULL AND y.section = x.section GROUP BY 1, 2, 3, 4 HAVING bool_and(CAST(x.v AS VARCHAR) = CAST(y.v AS VARCHAR))),
picked AS (SELECT feed_id, file_seq, rest[1:0] AS taken, rest FROM (SELECT feed_id, file_seq, list({'agree': agree, 'new': new, 'old': old} ORDER BY agree DESC, new DESC, old DESC) AS rest FROM fits GROUP BY 1, 2)
  UNION ALL SELECT feed_id, file_seq, list_append(taken, rest[1]), list_filter(rest[2:], lambda x: x.new <> rest[1].new AND x.old <> rest[1].old) FROM picked WHERE len(rest) > 0),
renamed AS (SELECT feed_id, file_seq, t.new AS new, t.old AS old FROM (SELECT feed_id, file_seq, unnest(taken) AS t FROM picked WHERE len(rest) = 0))
"""
_CANONICAL = "'modern', 'version', 'family', 'testcase', 'lines'"
_TEXT = "CASE WHEN {c}[1] = '\"' THEN {c}::JSON ->> '$' ELSE {c} END"
_LINEAGE = f""", places AS (SELECT feed_id, file_seq, row_number() OVER (PARTITION BY feed_id ORDER BY file_seq) AS pos FROM (SELECT DISTINCT feed_id, file_seq FROM section_rows)),
held AS (SELECT c.feed_id, p.pos, c.field FROM cat c JOIN places p USING (feed_id, file_seq)), moves AS (SELECT r.feed_id, p.pos, r.new, r.old FROM renamed r JOIN places p USING (feed_id, file_seq)),
lives AS (SELECT h.feed_id, h.pos, h.field, concat(h.field, '@', h.pos) AS life FROM held h ANTI JOIN held b ON b.feed_id = h.feed_id AND b.field = h.field AND b.pos = h.pos - 1 ANTI JOIN moves m ON m.feed_id = h.feed_id AND m.pos = h.pos AND m.new = h.field
  UNION ALL SELECT l.feed_id, l.pos + 1, h.field, l.life FROM lives l JOIN held h ON h.feed_id = l.feed_id AND h.pos = l.pos + 1
   LEFT JOIN moves m ON m.feed_id = l.feed_id AND m.pos = l.pos + 1 AND m.old = l.field WHERE h.field = coalesce(m.new, l.field)),
names AS (SELECT feed_id, life, coalesce(arg_min(field, pos) FILTER (field IN ({_CANONICAL})), arg_min(field, pos)) AS name FROM lives GROUP BY 1, 2),
fielded AS (SELECT o.feed_id, o.file_seq, o.row_no, unnest(json_keys(o.body)) AS field, o.body FROM once o),
named AS (SELECT f.feed_id, f.file_seq, f.row_no, CASE WHEN f.field IN ({_CANONICAL}) THEN f.field ELSE n.name END AS name, CAST(json_extract(f.body, '$."' || f.field || '"') AS VARCHAR) AS value
  FROM fielded f JOIN places p USING (feed_id, file_seq) JOIN lives l ON l.feed_id = f.feed_id AND l.pos = p.pos AND l.field = f.field JOIN names n ON n.feed_id = l.feed_id AND n.life = l.life),
valued AS (SELECT * FROM named WHERE value <> 'null'),
wide AS (SELECT r.feed_id, r.file_seq, r.row_no, {", ".join(f"CASE WHEN count(DISTINCT value) FILTER (name = '{c}') = 1 THEN min(value) FILTER (name = '{c}') END AS t_{c}, count(value) FILTER (name = '{c}') AS n_{c}" for c in ("section_id", "source", "modern", "version", "family", "testcase", "lines"))}
  FROM once r LEFT JOIN valued v USING (feed_id, file_seq, row_no) GROUP BY ALL),
casts AS (SELECT feed_id, file_seq, row_no, TRY_CAST({_TEXT.format(c="t_section_id")} AS BIGINT) AS section_id, {", ".join(f"{_TEXT.format(c='t_' + c)} AS {c}" for c in ("source", "version", "family", "testcase"))},
  CASE WHEN lower(trim({_TEXT.format(c="t_modern")})) IN ('true', 'yes', 'on', '1', 'y', 't') THEN true WHEN lower(trim({_TEXT.format(c="t_modern")})) IN ('false', 'no', 'off', '0', 'n', 'f') THEN false END AS modern,
  TRY_CAST({_TEXT.format(c="t_lines")} AS DECIMAL(38,9)) AS lines, {", ".join(f"n_{c}" for c in ("section_id", "source", "modern", "version", "family", "testcase", "lines"))} FROM wide),
judged AS (SELECT *, list_filter([{", ".join(f"CASE WHEN n_{c} > 0 AND {c} IS NULL THEN '{c}' END" for c in ("section_id", "source", "modern", "version", "family", "testcase", "lines"))}], lambda x: x IS NOT NULL) AS bad FROM casts)
SELECT j.feed_id, j.file_seq, j.row_no, j.section_id, j.source, j.modern, j.version, j.family, j.testcase, CAST(j.lines AS VARCHAR) AS lines,
 coalesce((SELECT string_agg(v.name || '=' || v.value, ';' ORDER BY v.name, v.value) FROM valued v WHERE v.feed_id = j.feed_id AND v.file_seq = j.file_seq AND v.row_no = j.row_no
  AND (v.name NOT IN ('section_id', 'source', {_CANONICAL}) OR list_contains(j.bad, v.name))), '') AS extra, array_to_string(j.bad, ',') AS failed FROM judged j"""
_P3_CUM = """
WITH w AS (SELECT path, value, count(*) AS weight FROM records GROUP BY ALL),
c AS (SELECT *, sum(weight) OVER (PARTITION BY path ORDER BY value) AS upto, sum(weight) OVER (PARTITION BY path) AS total FROM w WHERE value IS NOT NULL),
s AS (SELECT path, sum(weight) AS n_rows, coalesce(sum(weight) FILTER (value IS NULL), 0) AS n_null, count(value) AS n_distinct FROM w GROUP BY path),
q AS (SELECT path, min(value) FILTER (upto >= greatest(1, ceil(total * 50 / 100.0))) AS p50, min(value) FILTER (upto >= greatest(1, ceil(total * 90 / 100.0))) AS p90,
  min(value) FILTER (upto >= greatest(1, ceil(total * 99 / 100.0))) AS p99, arg_max(value, (weight, -value)) AS mode FROM c GROUP BY path)
"""
ORACLE = {
    "p1_found": _P1 + "SELECT row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_branch_records": _P1 + rf"""SELECT row_id, {", ".join(f"CAST(CAST('0' || ltrim(f{i}, '0') AS HUGEINT) AS VARCHAR) AS {c}" for i, c in ((1, "line_no"), (2, "line"), (3, "block")))}, f4 AS kind, f5 = '1' AS unreachable,
CASE WHEN f6 = '-' THEN NULL WHEN regexp_full_match(f6, '\+?[0-9]+') THEN CASE WHEN length(ltrim(f6, '+0')) > 19 THEN '9223372036854775807' ELSE CAST(least(CAST('0' || ltrim(f6, '+0') AS HUGEINT), 9223372036854775807) AS VARCHAR) END
 WHEN CAST(f6 AS DOUBLE) >= 9223372036854775808::DOUBLE THEN '9223372036854775807' ELSE CAST(CAST(trunc(CAST(f6 AS DOUBLE)) AS BIGINT) AS VARCHAR) END AS hits, f6 = '-' AS no_hits, f7 AS expression FROM judged WHERE reason IS NULL""",
    "p1_reasons": _P1 + "SELECT coalesce(reason, 'loaded') AS outcome, count(*) AS n FROM judged GROUP BY 1",
    "p2_found": _P2 + "SELECT DISTINCT a.input_id AS input_a, b.input_id AS input_b FROM sections a JOIN sections b ON a.tn = b.tn AND a.path = b.path AND a.body = b.body AND a.input_id < b.input_id",
    "p2_classes": _P2 + """, held AS (SELECT DISTINCT input_id, md5(concat_ws(chr(30), tn, path, body)) AS section FROM sections), sets AS (SELECT input_id, list_sort(list(section)) AS own FROM held GROUP BY 1),
links AS (SELECT a.input_id, count(DISTINCT b.input_id) - 1 AS links FROM held a JOIN held b USING (section) GROUP BY 1)
SELECT s.input_id, min(s.input_id) OVER (PARTITION BY own) AS class_id, count(*) OVER (PARTITION BY own) AS size, len(own) AS sections, links FROM sets s JOIN links USING (input_id)""",
    "p2_sections": _P2 + "SELECT DISTINCT tn, path, body FROM sections",
    "p3_found": """SELECT p.plan_id, (SELECT count(DISTINCT s.splitter) FROM splitters s WHERE s.plan_id = p.plan_id AND s.splitter <= h.path)::INTEGER AS range_no, h.path
FROM (SELECT path FROM records WHERE path IS NOT NULL GROUP BY path HAVING count(*) * 100 >= (SELECT count(*) FROM records)) h, (SELECT DISTINCT plan_id FROM splitters) p""",
    "p3_profile": _P3_CUM + "SELECT s.path, s.n_rows::BIGINT AS n_rows, s.n_null::BIGINT AS n_null, s.n_distinct, CAST(mode AS VARCHAR) AS mode, CAST(p50 AS VARCHAR) AS p50, CAST(p90 AS VARCHAR) AS p90, CAST(p99 AS VARCHAR) AS p99 FROM s LEFT JOIN q ON s.path IS NOT DISTINCT FROM q.path",
    "p3_ranges": """WITH k AS (SELECT path, count(*) AS n FROM records WHERE path IS NOT NULL GROUP BY path), p AS (SELECT plan_id, list(DISTINCT splitter) FILTER (splitter IS NOT NULL) AS b FROM splitters GROUP BY plan_id)
SELECT plan_id, len(list_filter(coalesce(b, []), lambda x: x <= path))::INTEGER AS range_no, sum(n)::BIGINT AS n_rows, count(*) AS n_paths FROM k, p GROUP BY 1, 2""",
    "p4_found": _P4 + "SELECT build_id, path, field FROM d",
    "p4_values": _P4 + "SELECT build_id, path, field, value_a, value_b FROM d",
    "p5_lifespans": _P5 + """, placed AS (SELECT *, dense_rank() OVER (PARTITION BY feed_id ORDER BY file_seq) AS pos FROM cat),
marked AS (SELECT *, pos - row_number() OVER (PARTITION BY feed_id, field, type ORDER BY pos) AS island FROM placed)
SELECT feed_id, field, type, min(file_seq) AS first_seq, max(file_seq) AS last_seq, count(*) AS files FROM marked GROUP BY feed_id, field, type, island""",
    "p5_found": _P5 + _RENAMED + """SELECT feed_id, file_seq, field, 'added' AS change FROM coming ANTI JOIN renamed r ON r.feed_id = coming.feed_id AND r.file_seq = coming.file_seq AND r.new = coming.field
UNION ALL SELECT feed_id, file_seq, field, 'removed' FROM going ANTI JOIN renamed r ON r.feed_id = going.feed_id AND r.file_seq = going.file_seq AND r.old = going.field
UNION ALL SELECT feed_id, file_seq, new, 'renamed' FROM renamed
UNION ALL SELECT m.feed_id, m.file_seq, c.field, 'retyped' FROM moved m JOIN cat c ON c.feed_id = m.feed_id AND c.file_seq = m.file_seq JOIN cat o ON o.feed_id = m.feed_id AND o.file_seq = m.prev AND o.field = c.field WHERE o.type <> c.type""",
    "p5_sections": _P5 + _RENAMED + _LINEAGE,
}
