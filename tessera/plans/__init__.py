"""Pipelines: parsing, rewriting, compiling, explaining."""
