"""The surface over a store: every question about it as a method that returns DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.commits import Store
from tidemark.functions import dates
from tidemark.lineage import settle
from tidemark.operators import answering, citations, contradictions, graph, resolve, search, store, temporal, vocabulary
from tidemark.schemas import empty

ROSTER_AS_OF = "2026-04-15"
NEEDED = ["documents", "chunks", "entities", "entity_aliases", "metric_vocab", "claims", "links", "contradictions"]


@dataclass(frozen=True)
class Answers:
    """What :meth:`Engine.ask` found, all by question_id.

    answers: answer, n_citations, cited_claims, confidence, route.  citations:
    pos, at, kind, ref_id, claim_id, chunk_id, link_id, source_uri, snippet,
    as_of.  contradictions: the stored rows that bear on the question, told or
    not.  coverage: earliest, latest, sources, stale of the cited evidence.
    facts: the numbered facts that were put before the model.
    """

    answers: DataFrame
    citations: DataFrame
    contradictions: DataFrame
    coverage: DataFrame
    facts: DataFrame


def _first(rows: DataFrame):
    row = rows.first()
    return row[0] if row else None


class Engine:
    """The tables of a store (missing ones are empty) and, for searches, its indexes.

    ``embed`` makes the vector of a text; without it searches go by words.
    ``speak`` stands for the model: of (question_id, question, grounding) it
    makes (question_id, pos, text, cites) and, if it likes, confidence; without
    it every answer is the fixed one.
    """

    def __init__(
        self, tables: dict[str, DataFrame], embed: Callable[[Column], Column] | None = None, speak: Callable[[DataFrame], DataFrame] | None = None,
        word_index: str | None = None, vector_index: str | None = None, buckets: int = 64, k: int = 8,
    ):
        if not tables:
            raise ValueError("no tables at all")
        self.spark = next(iter(tables.values())).sparkSession
        self.tables = {n: tables[n] if n in tables else empty(self.spark, n) for n in NEEDED}
        self.embed, self.speak, self.buckets, self.k = embed, speak, buckets, k
        self.word_index, self.vector_index = word_index, vector_index

    @classmethod
    def of_store(cls, kept: Store, version: int | None = None, **more) -> Engine:
        """All tables as of one version, so that commits in between are not seen by halves."""
        version = kept.version() if version is None else version
        return cls({n: kept.read(n, version) for n in NEEDED}, **more)

    def index(self, folder: str, cells: int = 64) -> Engine:
        """Writes the indexes of the chunks that searches need; all executors must see ``folder``."""
        self.word_index, self.vector_index = f"{folder}/words", f"{folder}/vectors"
        search.write_word_index(self.tables["chunks"], self.word_index, self.buckets)
        search.write_vector_index(self.tables["chunks"], self.vector_index, cells)
        return self

    # ---- names

    def _asked(self, questions: DataFrame | str) -> DataFrame:
        return self.spark.createDataFrame([(0, questions)], "question_id bigint, question string") if isinstance(questions, str) else questions

    def entity_id(self, name: str) -> int | None:
        """The entity of that name or alias; None if it is unknown or there are several."""
        asked = self.spark.createDataFrame([(0, name.strip(), {})], "mention_id int, name string, context map<string,string>")
        return _first(resolve.resolve(asked, self.tables["entities"], self.tables["entity_aliases"]).select("entity_id"))

    def canonical(self, predicate: str) -> str:
        """The key that a predicate belongs to, else the predicate itself."""
        asked = self.spark.createDataFrame([(predicate,)], "predicate string")
        return _first(vocabulary.canonical(asked, self.tables["metric_vocab"]).select("canonical_predicate"))

    # ---- inventory

    def get_sources(self) -> DataFrame:
        """The documents without their texts, by id."""
        d = self.tables["documents"]
        return d.select("id", "source_uri", "source_type", "title", "author", F.col("as_of").cast("string").alias("as_of")).orderBy("id")

    def list_entities(self, entity_type: str | None = None) -> DataFrame:
        return store.entity_list(self.tables["entities"], entity_type)

    def list_metrics(self) -> DataFrame:
        return store.metric_list(self.tables["metric_vocab"])

    # ---- search

    def search(self, questions: DataFrame | str, k: int = 10) -> DataFrame:
        """(question_id, rank, id, title, url, snippet, score, source_as_of, document_id): the best passages of every question, in the order of ranks.

        ``questions`` (question_id, question) may bring the words to look for
        as ``search`` and the vector as ``vector``.
        """
        hits = self._hits(self._asked(questions), k)
        return answering.search_rows(hits, self.tables["chunks"], self.tables["documents"]).orderBy("question_id", "rank")

    def _hits(self, questions: DataFrame, k: int) -> DataFrame:
        if self.word_index is None:
            raise RuntimeError("no indexes; index() writes them")
        there = set(questions.columns)
        lists = [search.search_words(questions, self.word_index, k, self.buckets, "search" if "search" in there else "question")]
        if "vector" in there or self.embed is not None:
            vector = F.col("vector") if "vector" in there else self.embed(F.col("question"))
            lists.append(search.search_vectors(questions.select("question_id", vector.alias("vector")), self.vector_index, k))
        return search.fused(lists, k)

    def fetch(self, ids: DataFrame | str) -> DataFrame:
        """Whole chunks by the handles (id) that a search gives; malformed and unknown ones have found = false."""
        asked = self.spark.createDataFrame([(ids,)], "id string") if isinstance(ids, str) else ids
        return answering.fetch_rows(asked, self.tables["chunks"], self.tables["documents"])

    # ---- one entity, one predicate, one topic

    def get_entity(self, name: str) -> dict[str, DataFrame]:
        """entity, aliases, claims (newest first) and links (either way, by id); all empty if the name is unknown."""
        one, t = self.entity_id(name), self.tables
        one = F.lit(one).cast("bigint")
        links = t["links"]
        return {
            "entity": t["entities"].where(F.col("id") == one),
            "aliases": t["entity_aliases"].where(F.col("entity_id") == one).select("alias").distinct().orderBy("alias"),
            "claims": t["claims"].where(F.col("subject_entity_id") == one).orderBy(F.col("as_of").desc_nulls_last(), "id"),
            "links": links.where((F.col("from_entity_id") == one) | (F.col("to_entity_id") == one)).orderBy("id"),
        }

    def get_timeline(self, entity: str, predicate: str) -> DataFrame:
        """An entity's claims that mean ``predicate``, oldest first, superseded ones too, each with its citation; empty if the name is unknown."""
        one, t = self.entity_id(entity), self.tables
        own = store.by_canonical_predicate(t["claims"].where(F.col("subject_entity_id") == F.lit(one).cast("bigint")), t["metric_vocab"], predicate)
        cited = store.cited_claims(own, t["chunks"], t["documents"], "id")
        return cited.select(
            F.col("id").alias("claim_id"), F.lit(self.canonical(predicate)).alias("predicate"), F.col("object_value").alias("value"), "as_of", "valid_from",
            "valid_to", "superseded_by", "confidence", "source_uri", "source_as_of", "snippet",
        ).orderBy(dates.or_first_day(F.col("as_of")), dates.or_first_day(F.col("valid_from")), "claim_id")

    def get_relationships(self, entity: str, link_type: str | None = None) -> DataFrame:
        """Links from and to an entity with names and citations, by type and id; a loop is outgoing; empty if the name is unknown."""
        one, t = self.entity_id(entity), self.tables
        own = graph.relationships(t["links"], F.lit(one).cast("bigint"), link_type)
        named = store.named(store.named(own, t["entities"], "from_entity_id", "from_name"), t["entities"], "to_entity_id", "to_name")
        cited = store.cited_links(named, t["chunks"], t["documents"])
        return cited.select(
            F.col("id").alias("link_id"), "link_type", "raw_verb", "direction", "from_entity_id", "from_name", "to_entity_id", "to_name", "as_of", "valid_to",
            "source_uri", "source_as_of", "snippet",
        ).orderBy("link_type", "link_id")

    def get_claims_by_predicate(self, predicate: str) -> DataFrame:
        """The claims of all subjects that mean ``predicate``, by subject, newest first."""
        t = self.tables
        own = store.named(store.by_canonical_predicate(t["claims"], t["metric_vocab"], predicate), t["entities"], "subject_entity_id", "subject_name")
        return store.cited_claims(own, t["chunks"], t["documents"], "id").select(
            F.col("id").alias("claim_id"), F.lit(self.canonical(predicate)).alias("predicate"), "subject_entity_id", "subject_name",
            F.col("object_value").alias("value"), "as_of", "valid_to", "superseded_by", "confidence", "source_uri", "source_as_of",
        ).orderBy(F.col("subject_entity_id").asc_nulls_last(), F.col("as_of").desc_nulls_last(), "claim_id")

    def get_org_chart(self, day: str | None = None, root: str | None = None) -> DataFrame:
        """The chart under ``root`` (the least root by default) as of a day: id, parent, depth, path, name, role, dotted."""
        top = None if root is None else self.entity_id(root)
        links = self.tables["links"] if root is None or top is not None else self.tables["links"].limit(0)
        return graph.org_chart(links, self.tables["entities"], day, top)

    def find_contradictions(self, topic: str | None = None) -> DataFrame:
        """Stored contradictions, all or those on the entity or the predicate that ``topic`` names, with their label, by id."""
        found = self.tables["contradictions"]
        if topic is not None:
            one = F.lit(self.entity_id(topic)).cast("bigint")
            found = found.where((F.col("subject_entity_id") == one) | (F.col("predicate") == self.canonical(topic)))
        return found.withColumn("label", contradictions.label(F.col("kind"), F.col("claim_a_id"))).orderBy("id")

    # ---- questions

    def ask(self, questions: DataFrame | str) -> Answers:
        """Answers to all questions (question_id, question) at once, made of cited sentences only.

        Each goes by its route: passages for those that need texts, subjects
        and their facts for those that need the store.  Contradictions on a
        subject or a topic are returned whatever the answer says.
        """
        t = self.tables
        asked = settle(self._asked(questions).withColumn("_r", answering.route(F.col("question"))))
        route = F.col("_r")["route"]
        terms = settle(answering.terms(asked))
        structured = asked.where(route != "retrieval").select("question_id")
        subjects = settle(resolve.subjects_of(terms.join(structured, "question_id", "left_semi"), t["entities"], t["entity_aliases"]))
        open_to = asked.where(F.col("_r")["wants_contradictions"]).select("question_id").unionByName(subjects.select("question_id")).distinct()
        topics = vocabulary.canonical(terms.join(open_to, "question_id", "left_semi"), t["metric_vocab"], "term")
        found = settle(answering.relevant(subjects, topics.select("question_id", F.col("canonical_predicate").alias("term")), t["contradictions"]))
        claims = answering.gather_claims(subjects, found, t["claims"])
        numbered = answering.numbered_claims(claims)
        of_links = answering.each_question(found.where("link_a_id IS NOT NULL OR link_b_id IS NOT NULL"))
        links = settle(answering.gather_links(subjects, of_links, t["links"]))
        passages = self._passages(asked.where(route != "structured").drop("_r"))
        others = settle(answering.other_facts(passages, links, t["entities"]))
        facts = answering.claim_facts(numbered).unionByName(others)
        told = asked.select("question_id", "question").join(self._grounding(claims, found, numbered, others), "question_id", "left")
        said = self._said(told.withColumn("grounding", F.coalesce("grounding", F.lit(""))))
        named = answering.named_facts(said, facts)
        cited = settle(answering.enforced(said, named, self._citations(named)))
        sure = said.groupBy("question_id").agg(F.max("confidence").alias("confidence"))
        answers = answering.answers(asked, cited, sure).join(asked.select("question_id", route.alias("route")), "question_id")
        return Answers(answers, cited, answering.each_question(found), temporal.source_coverage(cited, ["question_id"], ROSTER_AS_OF), facts)

    def _passages(self, questions: DataFrame) -> DataFrame:
        texts = self.tables["chunks"].select("id", "text")
        if self.word_index is None:
            none = F.lit(None)
            return questions.limit(0).select("question_id", none.cast("bigint").alias("id"), none.cast("int").alias("rank"), none.cast("string").alias("text"))
        return settle(self._hits(questions, self.k).join(texts, "id"))

    def _grounding(self, claims: DataFrame, found: DataFrame, numbered: DataFrame, others: DataFrame) -> DataFrame:
        """(question_id, grounding): facts, what most sources say of each predicate, and the conflicts among the facts."""
        keys = ["question_id", "predicate"]
        own = settle(vocabulary.canonical(answering.each_question(claims), self.tables["metric_vocab"]).drop("predicate").withColumnRenamed("canonical_predicate", "predicate"))
        sides = temporal.value_keys(own, keys).select(*keys, "value_key", "id")
        agreed = answering.consensus_lines(temporal.consensus(own, keys), sides, answering.claim_facts(numbered))
        label = contradictions.label(F.col("kind"), F.col("claim_a_id"))
        conflicts = answering.conflict_lines(found, {"claim": numbered, "link": answering.link_marks(others)}, label)
        facts = answering.claim_lines(numbered).unionByName(others.select("question_id", "pos", "line"))
        blocks = [
            facts.select("question_id", F.lit(0).alias("b"), F.format_string("%d/%09d", "pos.block", "pos.k").alias("at"), "line"),
            agreed.select("question_id", F.lit(1).alias("b"), F.col("predicate").alias("at"), "line"),
            conflicts.select("question_id", F.lit(2).alias("b"), F.format_string("%020d", "id").alias("at"), "line"),
        ]
        lines = blocks[0].unionByName(blocks[1]).unionByName(blocks[2])
        listed = F.transform(F.array_sort(F.collect_list(F.struct("b", "at", "line"))), lambda x: x["line"])
        return lines.groupBy("question_id").agg(F.array_join(listed, "\n").alias("grounding"))

    def _said(self, told: DataFrame) -> DataFrame:
        kind = told.schema["question_id"].dataType.simpleString()
        if self.speak is None:
            return self.spark.createDataFrame([], f"question_id {kind}, pos int, text string, cites array<string>, confidence double")
        said = self.speak(told)
        return settle(said if "confidence" in said.columns else said.withColumn("confidence", F.lit(None).cast("double")))

    def _citations(self, facts: DataFrame) -> DataFrame:
        """Citations of the facts alone, not of the whole store."""
        t, none = self.tables, F.lit(None).cast("bigint")
        own = lambda kind, name: t[name].join(facts.where(F.col("kind") == kind).select(F.col("ref_id").alias("id")).distinct(), "id", "left_semi")
        c = citations.of_claims(own("claim", "claims"), t["chunks"], t["documents"]).withColumn("link_id", none)
        s = citations.of_chunks(own("chunk", "chunks"), t["documents"]).withColumns({"claim_id": none, "link_id": none})
        k = citations.of_links(own("link", "links"), t["chunks"], t["documents"]).withColumn("claim_id", none)
        out = None
        for kind, rows in (("claim", c), ("chunk", s), ("link", k)):
            part = rows.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("ref_id"), "claim_id", "chunk_id", "link_id", "source_uri", "snippet", "as_of")
            out = part if out is None else out.unionByName(part)
        return out
