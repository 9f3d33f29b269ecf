"""Whole jobs: cleaning pipelines and the catalogue of analytic queries."""
