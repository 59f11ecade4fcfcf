from . import catalogue, graded, answers, lookups, ingestion, surface  # noqa: F401, I001  (the others add their queries to the catalogue)
