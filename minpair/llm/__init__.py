"""Operators for large-scale training-data pipelines.

Each ``opN_*`` module holds one operator with its own general interface;
``queries`` registers the thin ``opN_<name>`` queries and their SQL. Nothing
outside this subpackage (but ``__spark_entry__`` and ``corpus_pipeline``)
imports it.
"""
