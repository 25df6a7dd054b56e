"""Operators for preparing training text. Nothing outside this subpackage (but corpus_pipeline.py) imports it."""
