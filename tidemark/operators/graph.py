"""The link graph: roots, subtrees, relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import settle

from .temporal import snapshot


def reporting_edges(links: DataFrame, day: str | None = None) -> DataFrame:
    """(child, parent), distinct, of the reporting links that hold on ``day``."""
    own = snapshot(links.where(F.col("link_type") == "reports_to"), day)
    return own.select(F.col("from_entity_id").alias("child"), F.col("to_entity_id").alias("parent")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(root): parents that report to nobody."""
    return edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")), "root", "left_anti")


def subtree(edges: DataFrame, root: int | None = None, levels_at_once: int = 4) -> DataFrame:
    """(id, parent, depth, path) of all that report to ``root``, itself included; the least root by default.

    A node that is reached on several ways appears once, on the shortest, then
    least path.  The walk goes on from the nodes found last, some levels to a
    job, and passes over nodes that it has seen, so that neither cycles nor
    many ways to a node lengthen it and no depth is too great.
    """
    links = settle(edges.select(F.col("child").cast("bigint").alias("child"), F.col("parent").cast("bigint").alias("_up")).distinct())
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(root).cast("bigint").alias("id")) if root is not None else roots(edges).agg(F.min("root").cast("bigint").alias("id"))
    seen = settle(
        start.where("id IS NOT NULL").select(
            "id", F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth"), F.concat(F.lit("/"), "id", F.lit("/")).alias("path")
        )
    )
    last, depth = seen, 0
    while not last.isEmpty():
        found = level = None
        for _ in range(levels_at_once):
            step = (level if level is not None else last).join(links, F.col("id") == F.col("_up"))
            way = F.min(F.struct(F.concat("path", "child", F.lit("/")).alias("path"), F.col("id").alias("parent"))).alias("s")
            depth += 1
            level = step.groupBy("child").agg(way).select(F.col("child").alias("id"), "s.parent", F.lit(depth).alias("depth"), "s.path")
            found = level if found is None else found.unionByName(level)
        best = found.groupBy("id").agg(F.min(F.struct("depth", "path", "parent")).alias("s")).select("id", "s.parent", "s.depth", "s.path")
        fresh = settle(best.join(seen.select("id"), "id", "left_anti"))
        seen, last = seen.unionByName(fresh), fresh.where(F.col("depth") == depth)
        if depth % (8 * levels_at_once) == 0:
            seen = settle(seen)
    return seen


def dotted_lines(links: DataFrame, day: str | None = None) -> DataFrame:
    """(id, to_entity_id), distinct: dotted lines that hold on ``day``, by the entity that they start from."""
    own = snapshot(links.where(F.col("link_type") == "dotted_line_to"), day)
    return own.select(F.col("from_entity_id").alias("id"), "to_entity_id").distinct()


def with_roles(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """``nodes`` (id) with name and role of the entity: its role attribute if it is a person, else null."""
    role = F.when(F.col("entity_type") == "person", F.try_element_at("attributes", F.lit("role")))
    known = entities.select(F.col("id").alias("_e"), F.col("canonical_name").alias("name"), role.alias("role"))
    return nodes.join(known, F.col("id") == F.col("_e"), "left").drop("_e")


def org_chart(links: DataFrame, entities: DataFrame, day: str | None = None, root: int | None = None) -> DataFrame:
    """:func:`subtree` of the reporting links of ``day`` with names, roles and dotted, the sorted ends of each one's dotted lines."""
    nodes = with_roles(subtree(reporting_edges(links, day), root), entities)
    lines = dotted_lines(links, day).groupBy(F.col("id").alias("_from")).agg(F.array_sort(F.collect_list("to_entity_id")).alias("dotted"))
    none = F.array().cast("array<bigint>")
    return nodes.join(lines, F.col("id") == F.col("_from"), "left").drop("_from").withColumn("dotted", F.coalesce("dotted", none))


def relationships(links: DataFrame, entity: int, link_type: str | None = None) -> DataFrame:
    """Links from or to an entity with their direction and the other end; a loop is outgoing."""
    own = links.where((F.col("from_entity_id") == entity) | (F.col("to_entity_id") == entity))
    if link_type:
        own = own.where(F.col("link_type") == link_type)
    out = F.col("from_entity_id") == entity
    return own.withColumn("direction", F.when(out, "outgoing").otherwise("incoming")).withColumn(
        "other_id", F.when(out, F.col("to_entity_id")).otherwise(F.col("from_entity_id"))
    )


def named_relationships(links: DataFrame, entities: DataFrame, entity: int, link_type: str | None = None) -> DataFrame:
    """:func:`relationships` with the other end's name, null if it is unknown."""
    names = entities.select(F.col("id").alias("_e"), F.col("canonical_name").alias("other_name"))
    own = relationships(links, entity, link_type)
    return own.join(names, F.col("other_id") == F.col("_e"), "left").drop("_e")


def degrees(entities: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """(id, claims, outgoing, incoming) of every entity; a loop is outgoing only."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    marks = claims.select(F.col("subject_entity_id").alias("id"), one.alias("claims"), none.alias("outgoing"), none.alias("incoming"))
    out = links.select(F.col("from_entity_id").alias("id"), none.alias("claims"), one.alias("outgoing"), none.alias("incoming"))
    in_ = links.where("to_entity_id <> from_entity_id").select(
        F.col("to_entity_id").alias("id"), none.alias("claims"), none.alias("outgoing"), one.alias("incoming")
    )
    every = marks.unionByName(out).unionByName(in_).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("claims", "outgoing", "incoming")])
    return entities.select("id").join(every, "id", "left").na.fill(0, ["claims", "outgoing", "incoming"])


def entity_detail(entity: int, claims: DataFrame, links: DataFrame) -> DataFrame:
    """Facts about one entity: (fact, id, about, value, as_of), its claims and its links either way."""
    told = claims.where(F.col("subject_entity_id") == entity).select(
        F.lit("claim").alias("fact"), "id", F.col("predicate").alias("about"), F.col("object_value").alias("value"), "as_of"
    )
    linked = relationships(links, entity).select(
        F.col("direction").alias("fact"), "id", F.col("link_type").alias("about"), F.col("other_id").cast("string").alias("value"), "as_of"
    )
    return told.unionByName(linked)
