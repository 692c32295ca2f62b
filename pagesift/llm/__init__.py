"""Operators for training-data pipelines.  Nothing outside this subpackage
imports it; ``catalog.py`` registers one query per operator."""
