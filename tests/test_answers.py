"""What the steps from question to answer hand on."""

from tidemark.plans import answers

SF = "/root/testdata/sf0.001"


def test_only_facts_are_cited(spark):
    """Claims, chunks and links that are no facts of a question are not joined with texts."""
    refs = {"claim": [r[0] for r in answers.claims(spark, SF).select("id").limit(3).collect()], "chunk": [1, 2], "link": []}
    facts = spark.createDataFrame([(k, i) for k, ids in refs.items() for i in ids * 2], "kind string, ref_id bigint")
    got = sorted((r["kind"], r["ref_id"]) for r in answers._citations(spark, SF, facts).select("kind", "ref_id").collect())
    assert got == sorted((k, i) for k, ids in refs.items() for i in ids)
