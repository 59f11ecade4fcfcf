"""Tidemark: a temporal, provenance-carrying ontology engine on Spark DataFrames."""
