"""Verdigris: document retrieval, validity in time, registries and corpus curation on PySpark."""
