"""The seeded backbone: people, teams and lines of authority out of org charts, for a table of charts.

Every line of a chart is a row.  Expressions say what it is, windows what it
stands under, and edges are joins and unions of such rows.  A chart is a
document, so a window over one is as large as its longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.lineage import settle
from tidemark.operators.upsert import number

from .vocabulary import vocabulary

#: Columns of indentation that are told apart; deeper bullets count as this deep.
DEEPEST = 24
DASH = r"\s+[—–-]\s+"


def _bare(name: Column) -> Column:
    """A name without emphasis and blanks around it; null if nothing is left."""
    return F.nullif(F.btrim(name, F.lit("* \t\r")), F.lit(""))


def _part(value: Column, pattern: str) -> Column:
    return _bare(F.regexp_extract(value, pattern, 1))


def chart_lines(charts: DataFrame) -> DataFrame:
    """(chart, n, line and what it says) of charts (chart, body).

    ``team`` (a heading of two #), ``unit`` (of three), ``lead`` and ``above``
    (who a heading is under, and whom that one reports to), ``name``, ``depth``
    and ``about`` of a bullet with a bold name, ``cells`` of a table's row.
    """
    lines = charts.select("chart", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("n", "line"))
    title = lambda marks: F.nullif(F.regexp_extract("line", rf"^{marks}[ \t]+(.*\S)", 1), F.lit(""))
    two, three = title("##"), title("###")
    head = F.coalesce(two, three)
    bold = F.regexp_extract("line", r"^[ \t]*[-+][ \t]+\*\*([^*]+)\*\*", 1)
    margin = F.replace(F.regexp_extract("line", r"^([ \t]*)", 1), F.lit("\t"), F.lit("    "))
    row = F.regexp_extract("line", r"^[ \t]*\|(.*)\|[ \t]*$", 1)
    return lines.select(
        "chart", "n", "line", _part(two, r"^([^(,]*)").alias("team"), three.alias("unit"),
        _part(head, r"\bunder\s+([^,()→]+)").alias("lead"), _part(head, r"→\s*([^,()→]+)").alias("above"),
        _bare(bold).alias("name"), F.least(F.char_length(margin), F.lit(DEEPEST)).alias("depth"),
        F.split(F.btrim(F.regexp_extract("line", rf"\*\*({DASH}.*)$", 1), F.lit(" \t—–-")), DASH).alias("about"),
        F.when(row != "", F.transform(F.split(row, r"\|"), _bare)).alias("cells"),
    )


def placed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` under their headings: section (team and lead), unit_lead, the table's head row, and ``parent``, the bullet a bullet is under."""
    so_far = Window.partitionBy("chart").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda value, seen: F.last(F.when(seen, value), ignorenulls=True).over(so_far)
    team, unit = F.col("team").isNotNull(), F.col("unit").isNotNull()
    under = lines.select(
        "*", latest(F.struct(F.col("team").alias("name"), F.col("lead").alias("head")), team).alias("section"),
        latest(F.col("n"), team).alias("_section_at"), latest(F.struct("n", "lead"), unit).alias("_unit"), F.count_if(team | unit).over(so_far).alias("_block"),
    )
    # a unit's heading holds until the next section's
    own_unit = F.when(F.coalesce(F.col("_unit.n") > F.col("_section_at"), F.col("_unit").isNotNull()), F.col("_unit.lead"))
    in_block = Window.partitionBy("chart", "_block").orderBy("n")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    bullets = [
        F.last(F.when((F.col("depth") == k) & F.col("name").isNotNull(), F.struct("n", "name", "depth")), ignorenulls=True).over(before) for k in range(DEEPEST)
    ]
    shallower = F.filter(F.array(*bullets), lambda x: x["depth"] < F.col("depth"))
    titles = F.last(F.when(F.lower(F.col("cells")[0]) == "name", F.transform("cells", lambda c: F.lower(c))), ignorenulls=True).over(before)
    return under.select("*", own_unit.alias("unit_lead"), F.array_max(shallower)["name"].alias("parent"), titles.alias("titles")).drop("_unit", "_section_at", "_block")


def people(placed: DataFrame) -> DataFrame:
    """(chart, n, name, role, location, team, superior) of every bullet and table row that names a person.

    A bullet is under the bullet before it that is less deep, else under its
    unit's or section's lead; a row names its superior in a column of that
    title, and else is under the lead too.
    """
    lead = F.coalesce("unit_lead", "section.head")
    about = F.filter("about", lambda x: x != "")
    listed = placed.where("name IS NOT NULL").select(
        "chart", "n", "name", F.get(about, F.lit(0)).alias("role"), F.when(F.size(about) > 1, F.element_at(about, -1)).alias("location"),
        F.col("section.name").alias("team"), F.coalesce("parent", lead).alias("superior"),
    )
    cell = lambda title, place: F.get("cells", F.coalesce(F.nullif(F.array_position("titles", title), F.lit(0)) - 1, F.lit(place)).cast("int"))
    named = F.when(F.array_contains("titles", "reports to"), F.get("cells", (F.array_position("titles", "reports to") - 1).cast("int")))
    rows = placed.where(F.col("cells")[0].isNotNull() & (F.lower(F.col("cells")[0]) != "name") & ~F.col("cells")[0].rlike("^[:-]+$"))
    tabled = rows.select(
        "chart", "n", cell("name", 0).alias("name"), cell("role", 1).alias("role"), cell("location", 2).alias("location"),
        F.col("section.name").alias("team"), F.coalesce(named, lead).alias("superior"),
    )
    return listed.unionByName(tabled)


def authority(placed: DataFrame, persons: DataFrame) -> DataFrame:
    """(chart, from_name, to_name, link_type), distinct: reporting lines, dotted lines and memberships by name."""
    edge = lambda df, a, b, kind: df.select("chart", a.alias("from_name"), b.alias("to_name"), F.lit(kind).alias("link_type"))
    col = F.col
    headed = placed.where(col("lead").isNotNull())
    notes = placed.where(col("name").isNull() & col("cells").isNull() & F.contains(col("line"), F.lit("↔")))
    sides = F.explode(F.arrays_zip(*[F.transform(F.regexp_extract_all("line", F.lit(r"([^;(,↔]+)↔([^;),.↔]+)"), F.lit(k)), _bare).alias(x) for k, x in ((1, "a"), (2, "b"))]))
    dotted = notes.select("chart", sides.alias("s"))
    found = edge(persons, col("name"), col("superior"), "reports_to")
    for more in (
        edge(headed.where(col("team").isNotNull()), col("lead"), col("above"), "reports_to"),
        edge(headed.where(col("unit").isNotNull()), col("lead"), col("section.head"), "reports_to"),
        edge(dotted, col("s.a"), col("s.b"), "dotted_line_to"),
        edge(persons, col("name"), col("team"), "member_of"),
    ):
        found = found.unionByName(more)
    return found.where("from_name IS NOT NULL AND to_name IS NOT NULL AND from_name <> to_name").distinct()


def seed(charts: DataFrame, others: DataFrame | None = None) -> dict[str, DataFrame]:
    """The store's first rows out of charts (chart, body, as_of): metric_vocab, entities, entity_aliases and links.

    Of what several lines or charts say of a person the first (by chart, then
    line) stays.  ``others``: further entities (name, entity_type, kind,
    aliases).  Reporting and dotted lines are undated, with confidence 1 and
    0.8; memberships bear the chart's day.  A superior who is no entity, such
    as a board, is kept as the attribute reports_to_external.
    """
    spark = charts.sparkSession
    placed = settle(placed_lines(chart_lines(charts)))
    persons = people(placed)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("chart", "n"))).alias(c)
    known = persons.groupBy("name").agg(*[first(c) for c in ("role", "location", "team", "superior")], F.min(F.struct("chart", "n")).alias("at"))
    names = known.select(F.col("name").alias("superior"), F.lit(True).alias("_inside"))
    known = known.join(names, "superior", "left").withColumn("superior", F.when(F.col("_inside").isNull(), F.col("superior")))
    told = {"role": "role", "location": "location", "department": "team", "reports_to_external": "superior"}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in told.items()]), lambda x: x["value"].isNotNull())
    none = F.create_map().cast("map<string,string>")
    of_kind = lambda k: F.when(k.isNull(), none).otherwise(F.create_map(F.lit("kind"), k))
    rows = known.select(F.col("name").alias("canonical_name"), F.lit("person").alias("entity_type"), F.map_from_entries(pairs).alias("attributes"))
    teams = persons.where("team IS NOT NULL").select("team").distinct()
    rows = rows.unionByName(teams.select(F.col("team").alias("canonical_name"), F.lit("team").alias("entity_type"), of_kind(F.lit("department")).alias("attributes")))
    aliases = spark.createDataFrame([], "canonical_name string, alias string")
    if others is not None:
        rows = rows.unionByName(others.select(F.col("name").alias("canonical_name"), "entity_type", of_kind(F.col("kind")).alias("attributes")))
        aliases = others.select(F.col("name").alias("canonical_name"), F.explode("aliases").alias("alias"))
    merged = rows.groupBy("canonical_name", "entity_type").agg(F.first("attributes").alias("attributes"))
    entities = settle(number(merged, ["canonical_name", "entity_type"]).withColumn("seeded", F.lit(True)))
    ids = entities.select("id", "canonical_name", "entity_type")
    by_name = ids.groupBy("canonical_name").agg(F.min(F.struct(F.when(F.col("entity_type") == "person", 0).otherwise(1).alias("o"), "id")).alias("s"))
    by_name = by_name.select(F.col("canonical_name").alias("_name"), F.col("s.id").alias("_id"))
    of_team = ids.where("entity_type = 'team'").select(F.col("canonical_name").alias("_name"), F.col("id").alias("_id"))
    edges = authority(placed, persons)
    start, stop = by_name.toDF("from_name", "from_entity_id"), by_name.toDF("to_name", "to_entity_id")
    plain = edges.where("link_type <> 'member_of'").join(start, "from_name").join(stop, "to_name").select("from_entity_id", "to_entity_id", "link_type", F.lit(None).cast("date").alias("as_of"))
    days = charts.select("chart", F.col("as_of").cast("date").alias("as_of"))
    member = edges.where("link_type = 'member_of'").join(start, "from_name").join(of_team.toDF("to_name", "to_entity_id"), "to_name").join(days, "chart")
    links = plain.unionByName(member.select("from_entity_id", "to_entity_id", "link_type", "as_of")).distinct()
    links = links.withColumn("confidence", F.when(F.col("link_type") == "dotted_line_to", 0.8).otherwise(1.0))
    listed = aliases.join(by_name, F.col("canonical_name") == F.col("_name")).select(F.col("_id").alias("entity_id"), "alias").distinct()
    return {
        "metric_vocab": vocabulary(spark),
        "entities": entities.select("id", "canonical_name", "entity_type", "attributes", "seeded"),
        "entity_aliases": number(listed, ["entity_id", "alias"]).select("id", "entity_id", "alias"),
        "links": number(links, ["link_type", "from_entity_id", "to_entity_id", "as_of"]).select("id", "from_entity_id", "to_entity_id", "link_type", "as_of", "confidence"),
    }
