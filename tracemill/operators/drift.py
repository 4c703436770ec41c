"""Schemas that drift between the files of a feed: a change log and one consistent table.

The lifespan catalogue holds one row per feed, file, field and type (what the footers of columnar files would hold). ``lag``
over a feed's files and islands of neighbouring files give where a (field, type) starts and ends; starts and endings at the
same file are matched into renames by the values of the sections both files hold. Renames chain the lives of a field in its feed
together, and the alias table made from the chains generates the casts of the consistent table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import materialize

#: Fields with a fixed meaning in the consistent table: name and type.
CANONICAL = {"modern": "boolean", "version": "string", "family": "string", "testcase": "string", "lines": "decimal(38,9)"}


def json_type(kind: Column, text: Column) -> Column:
    """string, boolean, integer, number, list, object, or null for JSON null; ``kind`` is the variant's type, ``text`` its JSON."""
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "BIGINT", "integer")
        .otherwise(F.when(text.rlike("^-?[0-9]{19,}$"), "integer").otherwise("number"))
    )


def _objects(rows: DataFrame, *more: str) -> DataFrame:
    """Rows whose body is a JSON object, with it as the variant ``v``."""
    parsed = rows.select("feed_id", "file_seq", *more, F.try_parse_json("body").alias("v"))
    return parsed.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def _fields(objects: DataFrame, *more: str) -> DataFrame:
    """One row per named field of an object: ``field``, ``type`` and the variant ``item``."""
    each = objects.select("feed_id", "file_seq", *more, F.explode(F.expr("map_entries(CAST(v AS MAP<STRING, VARIANT>))")).alias("e")).select("feed_id", "file_seq", *more, F.col("e.key").alias("field"), F.col("e.value").alias("item"))
    # a JSON null comes out of the map as a null
    kind = F.coalesce(F.schema_of_variant("item"), F.lit("VOID"))
    return each.withColumn("type", json_type(kind, F.to_json("item")))


def unreadable(rows: DataFrame) -> DataFrame:
    """Rows whose body is null or no JSON object."""
    v = F.try_parse_json("body")
    return rows.filter(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))).select("feed_id", "file_seq", "row_no", "body")


def catalogue(rows: DataFrame) -> DataFrame:
    """feed_id, file_seq, field, type: a file has a field if a row names it; integers beside numbers make it a number.

    Other mixtures are joined with ``|`` in alphabetical order; a field that is null throughout has a null type. Bodies that
    aren't a JSON object are left out here and reported by ``unreadable``. One pass that combines before its shuffle.
    """
    types = F.array_sort(F.collect_set("type"))
    merged = F.when(F.array_contains(types, "number"), F.filter(types, lambda t: t != "integer")).otherwise(types)
    named = _fields(_objects(rows)).groupBy("feed_id", "file_seq", "field").agg(merged.alias("t"))
    return named.select("feed_id", "file_seq", "field", F.when(F.size("t") > 0, F.array_join("t", "|")).alias("type"))


def _ordinals(rows: DataFrame) -> DataFrame:
    """The files of each feed with their place in its order of ``file_seq``, also where a number is missing."""
    files = rows.select("feed_id", "file_seq").filter("feed_id IS NOT NULL AND file_seq IS NOT NULL").distinct()
    return files.withColumn("pos", F.row_number().over(Window.partitionBy("feed_id").orderBy("file_seq")))


def _islands(placed: DataFrame, *by: str) -> DataFrame:
    """Runs of neighbouring files: ``by``, first_seq, last_seq, files, first_pos, to_pos."""
    w = Window.partitionBy(*by).orderBy("pos")
    marked = placed.withColumn("before", F.lag("pos").over(w)).withColumn("island", F.sum(F.when(F.col("before") == F.col("pos") - 1, 0).otherwise(1)).over(w))
    spans = marked.groupBy(*by, "island").agg(F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("last_seq"), F.count("*").alias("files"), F.min("pos").alias("first_pos"), F.max("pos").alias("to_pos"))
    return spans.drop("island")


def lifespans(columns: DataFrame, files: DataFrame) -> DataFrame:
    """Islands of neighbouring files with the same field and type: feed_id, field, type, first_seq, last_seq, files, open_start, open_end.

    Neighbours are files next to each other in the feed's order of ``file_seq``, also where a number is missing.
    """
    ordinal = _ordinals(files)
    last = ordinal.groupBy("feed_id").agg(F.max("pos").alias("last_pos"))
    spans = _islands(columns.join(ordinal, ["feed_id", "file_seq"]), "feed_id", "field", "type")
    return spans.join(last, "feed_id").select("feed_id", "field", "type", "first_seq", "last_seq", "files", (F.col("first_pos") == 1).alias("open_start"), (F.col("to_pos") == F.col("last_pos")).alias("open_end"), "first_pos", "to_pos")


def _agreeing(rows: DataFrame, candidates: DataFrame, ordinal: DataFrame) -> DataFrame:
    """feed_id, pos, old, new, agree: candidate pairs whose values are the same in every section with both, one at least.

    Only the files around a candidate are read again, and of them only the candidate fields.
    """
    sides = [candidates.select("feed_id", "pos", (F.col("pos") - back).alias("at"), F.col(name).alias("field"), F.lit(name).alias("side")) for name, back in (("new", 0), ("old", 1))]
    wanted = sides[0].unionByName(sides[1]).distinct().join(ordinal.select("feed_id", F.col("pos").alias("at"), "file_seq"), ["feed_id", "at"])
    wanted = materialize(wanted.select("feed_id", "file_seq", "field", "pos", "side"), "wanted")
    near = rows.join(wanted.select("feed_id", "file_seq").distinct(), ["feed_id", "file_seq"], "left_semi")
    values = _fields(_objects(near).withColumn("section", F.expr("try_variant_get(v, '$.section_id', 'string')")).filter("section IS NOT NULL"), "section").filter("type IS NOT NULL")
    values = values.select("feed_id", "file_seq", "field", "section", F.to_json("item").alias("value")).join(wanted, ["feed_id", "file_seq", "field"])
    values = materialize(values.select("feed_id", "pos", "side", "field", "section", "value").distinct(), "values")
    new, old = (values.filter(F.col("side") == side).select("feed_id", "pos", "section", F.col("field").alias(side), F.col("value").alias(f"{side}_value")) for side in ("new", "old"))
    pairs = new.join(candidates, ["feed_id", "pos", "new"]).join(old, ["feed_id", "pos", "section", "old"])
    return pairs.groupBy("feed_id", "pos", "old", "new").agg(F.count_if(F.col("old_value") == F.col("new_value")).alias("agree"), F.count("*").alias("n")).filter("agree = n")


def changes(rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """feed_id, file_seq, field, change, old_field: every change of a file against the one before it in its feed.

    ``added``, ``removed`` and ``renamed`` fields and ``retyped`` ones (both types known). A rename needs the same type and, in
    every section of both files with non-null values for both names, the same value, with one such section at least. If
    several names fit, the pair with the most agreeing sections is taken first, then by name, and each name is used once.
    Rows repeated in full change nothing. ``columns`` is the catalogue of ``rows``, if it has been made already.
    """
    columns = materialize(catalogue(rows), "catalogue") if columns is None else columns
    ordinal = materialize(_ordinals(rows), "ordinals")
    spans = materialize(lifespans(columns, ordinal), "lifespans")

    starts = spans.filter("NOT open_start").select("feed_id", F.col("first_pos").alias("pos"), "field", "type")
    ends = spans.filter("NOT open_end").select("feed_id", (F.col("to_pos") + 1).alias("pos"), "field", "type")
    at = ["feed_id", "pos", "field"]
    retyped = starts.withColumnRenamed("type", "new_type").join(ends, at).filter("type IS NOT NULL AND new_type IS NOT NULL").select(*at)
    coming = starts.join(ends.select(*at), at, "left_anti")
    going = ends.join(starts.select(*at), at, "left_anti")

    candidates = coming.filter("type IS NOT NULL").select("feed_id", "pos", F.col("field").alias("new"), "type").join(going.select("feed_id", "pos", F.col("field").alias("old"), "type"), ["feed_id", "pos", "type"])
    fits = _agreeing(rows, materialize(candidates, "candidates"), ordinal)
    # the best first, each name once; ties are settled by name. Few fields change at a file.
    ranked = fits.groupBy("feed_id", "pos").agg(F.sort_array(F.collect_list(F.struct("agree", "new", "old")), asc=False).alias("fits"))
    none_yet = F.slice("fits", 1, 0)
    taken = F.reduce("fits", none_yet, lambda done, x: F.when(F.exists(done, lambda y: (y["new"] == x["new"]) | (y["old"] == x["old"])), done).otherwise(F.concat(done, F.array(x))))
    renamed = ranked.select("feed_id", "pos", F.explode(taken).alias("r")).select("feed_id", "pos", F.col("r.new").alias("field"), F.col("r.old").alias("old_field"))
    renamed = materialize(renamed, "renamed")

    none = F.lit(None).cast("string")
    added = coming.select(*at).join(renamed.select(*at), at, "left_anti")
    removed = going.select(*at).join(renamed.select("feed_id", "pos", F.col("old_field").alias("field")), at, "left_anti")
    log = (
        added.select(*at, F.lit("added").alias("change"), none.alias("old_field"))
        .unionByName(removed.select(*at, F.lit("removed").alias("change"), none.alias("old_field")))
        .unionByName(retyped.select(*at, F.lit("retyped").alias("change"), none.alias("old_field")))
        .unionByName(renamed.select(*at, F.lit("renamed").alias("change"), "old_field"))
    )
    return log.join(ordinal, ["feed_id", "pos"]).select("feed_id", "file_seq", "field", "change", "old_field")


def _chained(frame):
    """The lives of one feed's renamed fields with the name of their chain; lives are few, whatever the rows of the feed."""
    canonical = set(CANONICAL)
    lives = {(r.field, r.first_pos): r for r in frame[frame.kind == "life"].itertuples()}
    ending = {(field, r.to_pos): (field, first) for (field, first), r in lives.items()}
    after = {ending[r.old_field, r.first_pos - 1]: (r.field, r.first_pos) for r in frame[frame.kind == "renamed"].itertuples()}
    rows = []
    for root in lives.keys() - set(after.values()):
        chain = [root]
        while chain[-1] in after:
            chain.append(after[chain[-1]])
        name = next((field for field, _ in chain if field in canonical), root[0])
        rows += [(lives[x].feed_id, x[0], lives[x].first_pos, lives[x].to_pos, name) for x in chain if x[0] not in canonical and x[0] != name]
    return type(frame)(rows, columns=["feed_id", "field", "first_pos", "to_pos", "name"])


def aliases(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """feed_id, file_seq, aliases (map of field to name): the files with fields that go by another name.

    Renames chain the lives of a field within its feed. The chain's name is the first of its names that is in ``CANONICAL``, else its first
    name; a field with a canonical name keeps it. Feeds don't affect each other, and a name outside the chain's files isn't affected.
    """
    ordinal = materialize(_ordinals(rows), "ordinals")
    lives = _islands(columns.join(ordinal, ["feed_id", "file_seq"]), "feed_id", "field").select("feed_id", "field", F.col("first_pos").cast("bigint"), F.col("to_pos").cast("bigint"), F.lit(None).cast("string").alias("old_field"), F.lit("life").alias("kind"))
    renamed = changes(rows, columns).filter("change = 'renamed'").join(ordinal, ["feed_id", "file_seq"]).select("feed_id", "field", F.col("pos").cast("bigint").alias("first_pos"), F.lit(None).cast("bigint").alias("to_pos"), "old_field", F.lit("renamed").alias("kind"))
    renamed = materialize(renamed, "renames")
    touched = renamed.select("feed_id", F.explode(F.array("field", "old_field")).alias("field")).distinct()
    nodes = lives.join(touched, ["feed_id", "field"], "left_semi").unionByName(renamed)
    named = nodes.groupBy("feed_id").applyInPandas(_chained, "feed_id int, field string, first_pos bigint, to_pos bigint, name string")
    spread = named.join(ordinal, "feed_id").filter("pos BETWEEN first_pos AND to_pos")
    return spread.groupBy("feed_id", "file_seq").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("aliases"))


def _cast(value: Column, kind: str) -> Column:
    text = F.when(value.startswith('"'), F.try_variant_get(F.try_parse_json(value), "$", "string")).otherwise(value)
    if kind == "boolean":
        word = F.lower(F.trim(text))
        return F.when(word.isin("true", "yes", "on", "1", "y", "t"), True).when(word.isin("false", "no", "off", "0", "n", "f"), False)
    return text if kind == "string" else text.try_cast(kind)


def consistent(rows: DataFrame) -> DataFrame:
    """Every section row once, in one schema: feed_id, file_seq, row_no, section_id, source, the canonical fields, extra, failed.

    Values of aliased names (see ``aliases``) are cast to the canonical field's type. ``failed`` names, in the order of ``CANONICAL``, the
    fields whose value couldn't be cast or that got different values under several names; those values are in ``extra`` then,
    like all other fields, as (name, value as JSON text) in order. Rows repeated in full count once; unreadable bodies are left out.
    """
    columns = materialize(catalogue(rows), "catalogue")
    renamed = aliases(rows, columns)
    once = _objects(rows.select("feed_id", "file_seq", "row_no", "body").distinct(), "row_no")
    known = once.join(renamed, ["feed_id", "file_seq"], "left")
    entries = F.expr("map_entries(CAST(v AS MAP<STRING, VARIANT>))")
    name = lambda e: F.coalesce(F.when(F.col("aliases").isNotNull(), F.element_at("aliases", e["key"])), e["key"])
    named = known.withColumn("_all", F.filter(F.transform(entries, lambda e: F.struct(name(e).alias("name"), F.to_json(e["value"]).alias("value"))), lambda e: e["value"].isNotNull() & (e["value"] != "null")))
    of = lambda c: F.array_distinct(F.transform(F.filter("_all", lambda e: e["name"] == c), lambda e: e["value"]))
    texts = {c: of(c) for c in ("section_id", "source", *CANONICAL)}
    wide = named.select("feed_id", "file_seq", "row_no", "_all", *[texts[c].alias(f"_{c}") for c in texts])
    single = lambda c: F.when(F.size(f"_{c}") == 1, F.get(f"_{c}", F.lit(0)))
    kinds = {"section_id": "bigint", "source": "string"} | CANONICAL
    wide = wide.withColumns({c: _cast(single(c), kind) for c, kind in kinds.items()})
    wide = wide.withColumn("_failed", F.filter(F.array(*[F.when((F.size(f"_{c}") > 0) & F.col(c).isNull(), F.lit(c)) for c in kinds]), lambda x: x.isNotNull()))
    extra = F.array_sort(F.filter("_all", lambda e: ~e["name"].isin(*kinds) | F.array_contains("_failed", e["name"])))
    return wide.select("feed_id", "file_seq", "row_no", *kinds, extra.alias("extra"), F.array_join("_failed", ",").alias("failed"))
