"""Mentions to entities, in one batch: an ambiguous name stays unresolved."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import text
from tidemark.lineage import settle


def _agrees(attributes, context):
    """No hint of the context contradicts a value that the entity carries."""
    own = lambda e: F.try_element_at(attributes, e["key"])
    return F.forall(
        F.map_entries(context),
        lambda e: own(e).isNull() | F.contains(F.lower(own(e)), F.lower(e["value"])) | F.contains(F.lower(e["value"]), F.lower(own(e))),
    )


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, typed: bool = False) -> DataFrame:
    """(mention_id, entity_id): ``mentions`` has mention_id, name and context map<string,string>.

    Canonical names count before aliases; two aliases of an entity that fit are
    two candidates.  Of several candidates the seeded ones count if there are
    any, and of those still several only one that the context leaves over.
    ``typed``: a mention with an entity_type meets entities of that type only.
    Counts and least ids are all that is kept of the candidates.
    """
    kind = ["entity_type"] if typed else []
    named = mentions.select("mention_id", "context", *[F.col(c).alias("_type") for c in kind], F.lower("name").alias("_name"))
    e = entities.select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("_name"), "attributes", "seeded", *kind)
    kept = ["mention_id", "context", "entity_id", "attributes", "seeded"]
    fits_type = F.col("_type").isNull() | (F.col("_type") == F.col("entity_type")) if typed else F.lit(True)
    by_name = named.join(e, "_name").where(fits_type).select(*kept, F.lit(0).alias("tier"))
    by_alias = (
        named.join(aliases.select("entity_id", F.lower("alias").alias("_name")), "_name").join(e.drop("_name"), "entity_id")
        .where(fits_type).select(*kept, F.lit(1).alias("tier"))
    )
    found = by_name.unionByName(by_alias).withColumns(
        {"fits": F.coalesce(_agrees(F.col("attributes"), F.col("context")), F.lit(True)), "seeded": F.coalesce("seeded", F.lit(False))}
    )
    figures = []
    for t in (0, 1):
        for name, when in (("all", F.lit(True)), ("seeded", F.col("seeded"))):
            own = (F.col("tier") == t) & when
            figures += [F.count_if(own).alias(f"{name}{t}"), F.min(F.when(own, F.col("entity_id"))).alias(f"{name}{t}_id")]
            own = own & F.col("fits")
            figures += [F.count_if(own).alias(f"{name}{t}_fit"), F.min(F.when(own, F.col("entity_id"))).alias(f"{name}{t}_fit_id")]
    counts = found.groupBy("mention_id").agg(*figures)

    def one(name: str) -> Column:
        """The only candidate, or the only one that the context leaves over."""
        return F.when(F.col(name) == 1, F.col(f"{name}_id")).when(F.col(f"{name}_fit") == 1, F.col(f"{name}_fit_id"))

    def tier(t: int) -> Column:
        return F.when(F.col(f"all{t}") == 1, F.col(f"all{t}_id")).when(F.col(f"seeded{t}") > 0, one(f"seeded{t}")).otherwise(one(f"all{t}"))

    picked = counts.select("mention_id", F.when(F.col("all0") > 0, tier(0)).otherwise(tier(1)).alias("entity_id"))
    return mentions.select("mention_id").join(picked, "mention_id", "left")


# Types that mentions may add entities of, words before a name that are no part of it, and what a folder says of the department.
CREATABLE = ["customer", "metric", "product", "other"]
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam"]
DEPARTMENTS = {
    "customer_success": "Customer Success", "cs": "Customer Success", "engineering": "Engineering", "eng": "Engineering",
    "sales": "Sales", "leadership": "Executive", "finance": "Finance", "marketing": "Marketing", "people": "People", "it": "IT",
    "product__pos_self_service": "Product", "product": "Product",
}


@F.pandas_udf(StringType())
def _without_accents(names: pd.Series) -> pd.Series:
    import unicodedata

    bare = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return names.map(lambda x: bare(x) if isinstance(x, str) else None)


def fold_name(name: Column) -> Column:
    """A name without accents and honorifics, its words parted by single blanks, their case kept."""
    plain = F.when(F.octet_length(name) == F.char_length(name), name).otherwise(_without_accents(name))
    tokens = F.split(text.squeeze(plain), " ")
    return F.array_join(F.filter(tokens, lambda t: ~F.lower(F.btrim(t, F.lit("."))).isin(HONORIFICS)), " ")


def path_context(source_uri: Column) -> Column:
    """map<string,string>: the department that the first telling part of a path names, else empty."""
    known = F.create_map(*[F.lit(x) for kv in DEPARTMENTS.items() for x in kv])
    named = F.transform(F.split(F.lower(source_uri), r"[/\\\\]"), lambda t: F.try_element_at(known, F.trim(t)))
    first = F.get(F.filter(named, lambda d: d.isNotNull()), 0)
    return F.when(first.isNotNull(), F.create_map(F.lit("department"), first)).otherwise(F.create_map().cast("map<string,string>"))


def resolve_mentions(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention_id, entity_id, new_name, new_type, outcome) of ``mentions``, which also have entity_type and allow_snap.

    outcome: known (the name, or the folded one, is an entity of the type),
    snapped (one of any type is, and it is seeded or either type is other),
    minted (a new entity of a type that mentions may add, told by new_name and
    new_type), dropped (a person, a team, no name).  Mentions see each other's
    new entities, whatever their order: names whose folded forms differ in case
    at most are one new entity of each type, spelled as the least spelling, and
    those of type other that may snap are of the one other new type of that
    name, if there is just one and no entity or alias has the name.
    """
    own = mentions.withColumn("name", F.trim("name")).withColumn("_folded", fold_name(F.col("name")))
    blank = F.coalesce(F.col("name") == "", F.lit(True))

    def find(name: str, typed: bool, label: str) -> DataFrame:
        asked = own.select("mention_id", "context", "entity_type", F.col(name).alias("name")).where("name <> ''")
        return resolve(asked, entities, aliases, typed).withColumnRenamed("entity_id", label)

    out = own
    for label, name, typed in (("_a", "name", True), ("_b", "_folded", True), ("_c", "name", False), ("_d", "_folded", False)):
        out = out.join(find(name, typed, label), "mention_id", "left")
    about = entities.select(F.col("id").alias("_hit"), F.col("entity_type").alias("_hit_type"), F.col("seeded").alias("_hit_seeded"))
    for label in ("_c", "_d"):
        out = out.join(about.select(F.col("_hit").alias(f"{label}i"), F.col("_hit_type").alias(f"{label}t"), F.col("_hit_seeded").alias(f"{label}s")), F.col(label) == F.col(f"{label}i"), "left")
    joins = lambda c: F.when(F.coalesce(F.col(f"{c}s"), F.lit(False)) | (F.col("entity_type") == "other") | (F.col(f"{c}t") == "other"), F.col(c))
    known = F.coalesce("_a", "_b")
    snapped = F.when(F.coalesce(F.col("allow_snap"), F.lit(True)), F.coalesce(joins("_c"), joins("_d")))
    open_class = F.coalesce(F.col("entity_type").isin(CREATABLE) & (F.col("_folded") != ""), F.lit(False))
    outcome = (
        F.when(blank, "dropped").when(known.isNotNull(), "known").when(open_class & snapped.isNotNull(), "snapped").when(open_class, "minted").otherwise("dropped")
    )
    out = out.withColumn("outcome", outcome).withColumn("entity_id", F.when(F.col("outcome") == "known", known).when(F.col("outcome") == "snapped", snapped))
    minted, keys = F.col("outcome") == "minted", ["_key", "entity_type", "_snap"]
    told = settle(out.select("mention_id", "entity_id", "outcome", "name", "entity_type", F.lower("_folded").alias("_key"), F.coalesce("allow_snap", F.lit(True)).alias("_snap")))
    taken = entities.select(F.lower("canonical_name").alias("_key")).unionByName(aliases.select(F.lower("alias").alias("_key"))).distinct().withColumn("_taken", F.lit(True))
    spelled = told.where(minted).groupBy(*keys).agg(F.min("name").alias("_least")).join(taken, "_key", "left")
    same_name = Window.partitionBy("_key")  # as many rows as types, twice
    own_type = F.when(F.col("entity_type") != "other", F.col("entity_type"))
    single = F.col("_taken").isNull() & (F.min(own_type).over(same_name) == F.max(own_type).over(same_name))
    spelled = spelled.withColumn("new_type", F.when(F.col("_snap") & single, F.min(own_type).over(same_name)).otherwise(F.col("entity_type")))
    named = spelled.select(*keys, "new_type", F.min("_least").over(Window.partitionBy("_key", "new_type")).alias("new_name"))
    new = told.where(minted).join(named, keys)
    rest = told.where(~minted).withColumns({"new_name": F.lit(None).cast("string"), "new_type": F.lit(None).cast("string")})
    columns = ["mention_id", "entity_id", "new_name", "new_type", "outcome"]
    return new.select(*columns).unionByName(rest.select(*columns))


def outcomes(resolved: DataFrame) -> DataFrame:
    """(outcome, n) over the mentions of :func:`resolve_mentions`; dropped ones are what a run reports as lost."""
    return resolved.groupBy("outcome").agg(F.count("*").alias("n"))


def subjects_of(terms: DataFrame, entities: DataFrame, aliases: DataFrame, most: int = 6) -> DataFrame:
    """(question_id, entity_id, position): the first ``most`` entities that the terms (question_id, pos, term) of each question name.

    A term is looked up once, however often and in whatever case it is asked.
    """
    key = F.lower(F.trim("term"))
    asked = terms.select(key.alias("name")).distinct().select(F.col("name").alias("mention_id"), "name", F.create_map().cast("map<string,string>").alias("context"))
    known = resolve(asked, entities, aliases).where("entity_id IS NOT NULL")
    first = terms.join(known, key == F.col("mention_id")).groupBy("question_id", "entity_id").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("question_id").orderBy("pos", "entity_id")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("question_id", "entity_id", "position")
