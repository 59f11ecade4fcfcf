"""What follows a model's answer: coercion, validation, grounding, merging of passes, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

# Verbs of each link type, those that name the superior first, and types of subjects.
VERBS = {
    "reports_to": ["manages", "manage", "managed by", "is managed by", "reports to", "report to", "reports into", "reports_to"],
    "dotted_line_to": [
        "leads", "lead", "functional lead", "dotted line", "dotted-line", "dotted line to", "dotted-line to", "dotted_line_to",
    ],
    "member_of": ["member of", "member_of", "part of", "part_of", "belongs to"],
    "owns": ["owns", "own", "owner of"],
    "mentions": ["mentions", "mention", "references"],
}
SUPERIOR_FIRST = ["manages", "manage", "leads", "lead", "functional lead"]
SUBJECT_TYPES = ["person", "team", "customer", "product", "metric", "other"]
COMPANY_TYPES = ["company", "organization", "organisation", "org", "subsidiary", "business", "firm", "corporation"]
#: A number as texts write it, with a scale letter or a per cent sign.
NUMBER = r"(?i)(?<![A-Za-z\d])[−-]?\d[\d,]*\.?\d*\s*[kmb]?\s*%?"
OVERLAP = 0.6
PENALTY, FLOOR = 0.5, 0.1


def coerce_links(relations: DataFrame) -> DataFrame:
    """``relations`` (from_entity, to_entity, link_type) with known link types, ends turned where the verb names the superior first.

    Adds raw_verb (an unknown verb, which becomes ``mentions``) and drop_reason
    (set where there is no verb at all).
    """
    verb = F.lower(F.trim("link_type"))
    known = F.lit(None).cast("string")
    for name, verbs in VERBS.items():
        known = F.when(verb.isin(verbs), name).otherwise(known)
    turned = F.coalesce(verb.isin(SUPERIOR_FIRST), F.lit(False))
    absent = F.coalesce(verb == "", F.lit(True))
    return relations.withColumns(
        {
            "from_entity": F.when(turned, F.col("to_entity")).otherwise(F.col("from_entity")),
            "to_entity": F.when(turned, F.col("from_entity")).otherwise(F.col("to_entity")),
            "link_type": F.when(~absent, F.coalesce(known, F.lit("mentions"))),
            "raw_verb": F.when(~absent & known.isNull(), verb),
            "drop_reason": F.when(absent, "unmappable_enum"),
        }
    )


def coerce_subject_types(claims: DataFrame) -> DataFrame:
    """``claims`` with a known subject_type; an unknown one becomes other and is kept in raw_subject_type."""
    given = F.lower(F.trim("subject_type"))
    fits, company = given.isin(SUBJECT_TYPES), given.isin(COMPANY_TYPES)
    return claims.withColumns(
        {
            "subject_type": F.when(given.isNotNull(), F.when(fits, given).otherwise("other")),
            "raw_subject_type": F.when(~fits & ~company, given),
        }
    )


def _words(x: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, parted by single blanks."""
    return F.trim(F.regexp_replace(text.fold(x), "[^a-z0-9]+", " "))


def _number_in(written: Column) -> Column:
    """The number of a candidate, which holds digits and at most a scale letter: no words to expand."""
    plain = F.regexp_replace(F.replace(F.lower(written), F.lit("−"), F.lit("-")), r"(?<=\d),(?=\d)", "")
    return text.value_number(text.squeeze(plain))


def graded(claims: DataFrame) -> DataFrame:
    """``claims`` (evidence, object_value, chunk_text) with grade.

    ungrounded if the evidence is blank or does not give the value; else exact
    or, for a paraphrase, value_only.  A numeric value is given by an equal
    number in the evidence, a text by its words.  Evidence is no paraphrase if
    its words stand in the chunk, or three fifths of its distinct ones do.
    Normal forms are columns of their own, so that each is worked out once.
    """
    c = F.col
    forms = claims.withColumns(
        {
            "_value": text.value_text(c("object_value")),
            "_own": _words(c("object_value")),
            "_spoken": _words(c("evidence")),
            "_body": _words(F.coalesce("chunk_text", F.lit(""))),
        }
    ).withColumns({"_number": text.value_number(c("_value")), "_tokens": F.array_distinct(F.split("_spoken", " "))})
    shared = F.size(F.array_intersect("_tokens", F.split("_body", " "))) / F.size("_tokens")
    quoted = (c("_spoken") != "") & (F.contains(c("_body"), c("_spoken")) | (shared >= OVERLAP))
    candidates = F.transform(F.regexp_extract_all("evidence", F.lit(NUMBER), 0), _number_in)
    near = lambda x: F.abs(x - c("_number")) <= F.greatest(F.lit(1e-9), 1e-9 * F.greatest(F.abs(x), F.abs(c("_number"))))
    by_number = F.exists(candidates, lambda x: F.coalesce(near(x), F.lit(False)))
    by_words = (c("_own") != "") & F.contains(c("_spoken"), c("_own"))
    given = F.when(c("object_value").isNull(), F.lit(True)).when(c("_number").isNotNull(), by_number).otherwise(by_words)
    blank = F.coalesce(text.squeeze(c("evidence")) == "", F.lit(True))
    grade = F.when(blank | ~given, "ungrounded").when(quoted, "exact").otherwise("value_only")
    return forms.withColumn("grade", grade).drop("_value", "_own", "_spoken", "_body", "_number", "_tokens")


def penalized(confidence: Column, grade: Column) -> Column:
    """Half the confidence of an ungrounded claim, a tenth at least."""
    return F.when(grade == "ungrounded", F.greatest(F.lit(FLOOR), confidence * PENALTY)).otherwise(confidence)


def locate(evidence: Column, body: Column) -> Column:
    """(char_start, char_end) of the evidence where it stands once; null if it is blank, absent or repeated.

    Without a verbatim place, one that differs in case and white space counts.
    """
    quoted = F.transform(F.split(text.squeeze(evidence), " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit("(?iu)"), F.array_join(quoted, r"\s+"))
    n = text.occurrences(body, evidence)
    place = lambda at, size: F.struct((at - 1).cast("int").alias("char_start"), (at - 1 + size).cast("int").alias("char_end"))
    found = F.regexp_substr(body, pattern)
    loosely = F.when(F.regexp_count(body, pattern) == 1, place(F.position(found, body), F.char_length(found)))
    blank = F.coalesce(text.squeeze(evidence) == "", F.lit(True)) | body.isNull()
    return F.when(~blank & (n == 1), place(F.position(evidence, body), F.char_length(evidence))).when(~blank & (n == 0), loosely)


def merge_passes(items: DataFrame, keys: list[Column], arrival: list[str]) -> DataFrame:
    """The first item of each key by ``arrival``; keys are compared as equal if null."""
    order = Window.partitionBy(*keys).orderBy(*arrival)
    return items.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def claim_key() -> list[Column]:
    """The key by which claims of several passes are one."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return [plain("subject"), plain("predicate"), plain("object_value"), F.trim(F.coalesce(F.col("as_of").cast("string"), F.lit("")))]


def repair_metric_subjects(claims: DataFrame, vocab: DataFrame, primary: str) -> DataFrame:
    """Claims whose subject is a known metric become the primary entity's, with the metric as predicate unless it names one already."""
    from .vocabulary import terms

    t = terms(vocab).select("term")
    subject = t.select(F.col("term").alias("_s"))
    predicate = t.select(F.col("term").alias("_p"))
    joined = claims.join(subject, text.strip_period(F.col("subject")) == F.col("_s"), "left").join(
        predicate, text.strip_period(F.col("predicate")) == F.col("_p"), "left"
    )
    moved = F.coalesce((F.col("subject_type") == "metric") & F.col("_s").isNotNull(), F.lit(False))
    return joined.withColumns(
        {
            "subject": F.when(moved, F.lit(primary)).otherwise(F.col("subject")),
            "subject_type": F.when(moved, F.lit("other")).otherwise(F.col("subject_type")),
            "predicate": F.when(moved & F.col("_p").isNull(), F.col("subject")).otherwise(F.col("predicate")),
        }
    ).drop("_s", "_p")


def assemble_claims(claims: DataFrame) -> DataFrame:
    """Resolved claims (subject_entity_id, as_of, document_as_of), dated by their document if undated; those without a subject are gone."""
    return claims.where("subject_entity_id IS NOT NULL").withColumn("as_of", F.coalesce("as_of", "document_as_of"))


def assemble_links(relations: DataFrame) -> DataFrame:
    """Resolved relations (from_entity_id, to_entity_id, as_of, document_as_of) that are no loops, dated by their document if undated."""
    ends = F.col("from_entity_id") != F.col("to_entity_id")
    return relations.where(ends).withColumn("as_of", F.coalesce("as_of", "document_as_of"))
