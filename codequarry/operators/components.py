"""Relationships between components of files, and the files that imports mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import python_source, source_text
from codequarry.operators.text import sources
from codequarry.plans.registry import query

col = F.col
STRENGTH = {"Inheritance": 10, "Composition": 8, "Override": 7, "MethodCall": 5, "FunctionCall": 5, "TypeReference": 3, "Import": 2, "Dependency": 1}


def pieces(text: Column, lengths: Column) -> Column:
    """The distinct parts of a text of some lengths."""
    starts = lambda n: F.sequence(F.lit(1), F.length(text) - n + 1)
    fits = F.filter(lengths, lambda n: n <= F.length(text))
    return F.array_distinct(F.flatten(F.transform(fits, lambda n: F.transform(starts(n), lambda at: F.substring(text, at, n)))))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """id, imported and the first file (by created_at, then id) whose stem contains what is imported or is contained in it; of files (file_id, path, created_at).

    Contained texts are found by equality with all parts of the longer text that are as long as any of the shorter ones, so that both
    directions are joins on a text. Of a part that many stems share only the first file is kept, by a minimum that is taken before the shuffle."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    first = F.min(F.struct("created_at", "file_id", "path")).alias("first")
    stems = files.select(stem.alias("stem"), "created_at", "file_id", "path").groupBy("stem").agg(first)
    wanted = imports.select("imported").where("imported IS NOT NULL").distinct()
    lengths = lambda df, x: F.broadcast(df.agg(F.collect_set(F.length(x)).alias("lengths")))  # noqa: E731 one row, as many numbers as there are lengths
    # the import holds the stem
    parts = wanted.join(lengths(stems, "stem"), F.lit(True)).select("imported", F.explode(pieces(col("imported"), col("lengths"))).alias("stem"))
    holds = parts.join(stems, "stem").select("imported", "first")
    # the stem holds the import
    index = stems.join(lengths(wanted, "imported"), F.lit(True)).select(F.explode(pieces(col("stem"), col("lengths"))).alias("imported"), "first").groupBy("imported").agg(F.min("first").alias("first"))
    held = wanted.join(index, "imported").select("imported", "first")
    best = holds.unionByName(held).groupBy("imported").agg(F.min("first").alias("first"))
    return imports.join(best, "imported").select("id", "imported", "first.file_id", "first.path")


@query("""WITH s AS (SELECT id AS file_id, original_path AS path, regexp_extract(original_path, '[^/]*$') AS stem, created_at FROM f_containers), i AS (SELECT DISTINCT imported FROM f_imports),
best AS (SELECT imported, arg_min(file_id, (created_at, file_id)) AS file_id, arg_min(path, (created_at, file_id)) AS path FROM i JOIN s ON contains(imported, stem) OR contains(stem, imported) GROUP BY imported)
SELECT f.id, f.imported, file_id, path FROM f_imports f JOIN best USING (imported)""")
def g23_resolved_imports(c):
    return resolved(c.imports, c.containers.select(col("id").alias("file_id"), col("original_path").alias("path"), "created_at"))


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """points (path, place, ...) with holder: the place of the innermost of spans (path, place, last, parent) that holds each, null if none.

    Spans nest. Where one ends, the one that holds it goes on; so a point's holder is what the last begin or end before it says, one sweep over
    a file's places in order. A span that begins at the point holds it."""
    marks = F.array(F.struct(col("place").alias("place"), F.lit(0).alias("turn"), col("place").alias("holder")), F.struct(col("last").alias("place"), F.lit(2).alias("turn"), col("parent").alias("holder")))
    events = spans.select("path", F.explode(marks).alias("e"), F.lit(None).cast(points.schema.simpleString()).alias("point")).select("path", "e.*", "point")
    asked = points.select("path", "place", F.lit(1).alias("turn"), F.lit(None).cast("long").alias("holder"), F.struct(*points.columns).alias("point"))
    # spans that end together end inner ones first: those that begin last
    order = Window.partitionBy("path").orderBy("place", "turn", F.when(col("turn") == 2, -F.coalesce("holder", F.lit(-1))).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(col("turn") != 1, F.struct("holder"))
    return events.unionByName(asked).withColumn("now", F.last(mark, ignorenulls=True).over(order)).where("turn = 1").select("point.*", col("now.holder").alias("holder"))


def relationships(files: DataFrame) -> DataFrame:
    """path, from, to, type, strength and is_local, each once: calls and attributes from the function or class around them, bases from their class, imports from the file."""
    found = python_source.components(files)
    spans = found.where("kind IN ('function', 'class')")
    points = innermost(spans.select("path", "place", "last", "parent"), found.where("kind IN ('call', 'attribute', 'base', 'import')").select("path", "kind", "name", "place"))
    named = points.join(spans.select("path", col("place").alias("holder"), col("name").alias("from"), col("kind").alias("within")), ["path", "holder"], "left")
    known = spans.select("path", "name", col("kind").alias("defined")).distinct()
    to_known = named.join(known, ["path", "name"])
    kinds = ("call", "function", "FunctionCall"), ("base", "class", "Inheritance"), ("attribute", "class", "Composition")
    kind = F.coalesce(*(F.when((col("kind") == a) & (col("defined") == b), t) for a, b, t in kinds))
    own = to_known.withColumn("type", kind).where("type IS NOT NULL").select("path", F.coalesce("from", "path").alias("from"), col("name").alias("to"), "type")
    imports = points.where("kind = 'import'").select("path", col("path").alias("from"), col("name").alias("to"), F.lit("Import").alias("type"))
    strength = F.create_map(*(F.lit(x) for kv in STRENGTH.items() for x in kv))[col("type")]
    local = (col("type") != "Import") & ~source_text.any_of(col("to"), (".", "/"))
    return own.unionByName(imports).distinct().select("path", "from", "to", "type", strength.alias("strength"), local.alias("is_local"))


@query("""WITH p AS (SELECT path, n FROM f_files WHERE language = 'python') SELECT path, 'm' AS "from", 'g' AS "to", 'FunctionCall' AS type, 5 AS strength, TRUE AS is_local FROM p WHERE n > 0 UNION ALL SELECT path, 'o', 'p', 'FunctionCall', 5, TRUE FROM p
UNION ALL SELECT path, 'D', 'C' || path, 'Inheritance', 10, TRUE FROM p UNION ALL SELECT path, 'C' || path, 'D', 'Composition', 8, TRUE FROM p UNION ALL SELECT path, path, 'os', 'Import', 2, FALSE FROM p""")
def g35_component_relationships(c):
    return relationships(sources(c, "python"))
