"""Typed JSON objects and the relations between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECTS = "id long, type_name string, props string, sync_clock long, writer string, is_deleted boolean"


def property_text(props: Column, name: str) -> Column:
    """A property as text: strings and numbers only; null for booleans, nulls, nested or missing ones and broken JSON."""
    value = F.try_variant_get(F.try_parse_json(props), f"$['{name}']", "variant")
    kind = F.schema_of_variant(value)
    plain = (kind == "STRING") | (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    return F.when(plain, F.try_variant_get(F.try_parse_json(props), f"$['{name}']", "string"))


def live(objects: DataFrame) -> DataFrame:
    return objects.filter(~F.col("is_deleted"))


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each id, by clock, then writer: (id, type_name, props, sync_clock, writer, is_deleted)."""
    rest = [c for c in versions.columns if c != "id"]
    won = versions.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("sync_clock", "writer", "is_deleted", "props")).alias("v"))
    return won.select("id", *(F.col(f"v.{c}").alias(c) for c in rest))


def upsert(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """Objects after `changes` (id, type_name, props): properties are replaced wholly, tombstones cleared, clocks go up by one."""
    old = objects.select("id", F.col("sync_clock").alias("_clock"))
    new = changes.join(old, "id", "left").select("id", "type_name", "props", (F.coalesce("_clock", F.lit(0)) + 1).alias("sync_clock"), F.lit("").alias("writer"), F.lit(False).alias("is_deleted"))
    return objects.join(changes.select("id"), "id", "left_anti").unionByName(new)


def get(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """id, type_name, props of live objects whose JSON is sound, with `id` and `_type` put into it."""
    own = F.to_json(F.struct("id", F.col("type_name").alias("_type")))
    inner = F.regexp_extract("props", r"(?s)^\s*\{(.*)\}\s*$", 1)
    merged = F.when(F.trim(inner) == "", own).otherwise(F.concat(F.regexp_replace(own, r"\}$", ""), F.lit(","), inner, F.lit("}")))
    sound = live(objects).join(ids.select("id"), "id", "left_semi").filter(F.try_parse_json("props").isNotNull())
    return sound.select("id", "type_name", merged.alias("props"))


def remove(objects: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, edges): live objects among `ids` become tombstones with a higher clock, and their edges go."""
    gone = live(objects).join(ids.select("id"), "id", "left_semi")
    dead = gone.withColumn("sync_clock", F.col("sync_clock") + 1).withColumn("is_deleted", F.lit(True))
    return objects.join(gone.select("id"), "id", "left_anti").unionByName(dead.select(*objects.columns)), without_records(edges, gone)


def where(objects: DataFrame, type_name: str, name: str | None = None, value: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Live objects of a type, by id; with a property, those whose text equals `value`."""
    found = live(objects).filter(F.col("type_name") == type_name)
    if name is not None and value is not None:
        found = found.filter(property_text(F.col("props"), name) == value)
    if limit is None:
        return found
    return found.orderBy("id").offset(offset).limit(limit)


def counts(objects: DataFrame) -> DataFrame:
    return live(objects).groupBy("type_name").agg(F.count("*").alias("n"))


def property_index(objects: DataFrame) -> DataFrame:
    """type_name, key, value, id: every string or number property of the live objects."""
    parsed = live(objects).select("id", "type_name", F.try_parse_json("props").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant(F.col("value"))
    plain = kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return each.filter(plain).select("type_name", "key", F.try_variant_get(F.col("value"), "$", "string").alias("value"), "id")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("relation", "from_id", "to_id").distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return distinct_edges(edges.unionByName(more))


def targets(edges: DataFrame, relation: str, ids: DataFrame) -> DataFrame:
    """from_id, to_id of the relation's edges that leave `ids` (id)."""
    return edges.filter(F.col("relation") == relation).join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("from_id", "to_id")


def sources(edges: DataFrame, relation: str, ids: DataFrame) -> DataFrame:
    """from_id, to_id of the relation's edges that reach `ids` (id)."""
    return edges.filter(F.col("relation") == relation).join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["relation", "from_id", "to_id"], "left_anti")


def without_records(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with neither end among `ids` (id)."""
    gone = ids.select("id").distinct()
    return edges.join(gone, edges["from_id"] == gone["id"], "left_anti").join(gone, edges["to_id"] == gone["id"], "left_anti")
