"""Operators for large training-data pipelines: deduplication, decontamination,
classification, sharding, archive conversion, chat formatting and tokenisation.

Each module holds one operator. ``queries`` registers the query of each with the
SQL statement that checks it, where SQL can express it.
"""
