"""Gleanery: page-corpus, evidence-table and detector-score analytics as Spark jobs."""
