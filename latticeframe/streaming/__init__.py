"""Incremental ingest: each stored page is processed once, and a run resumes where the last one ended."""
