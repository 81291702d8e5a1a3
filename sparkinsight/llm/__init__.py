"""Operators of a training-data pipeline (secrets, quality, mixing, dedup, packing, ...).

Each module holds one operator with a general interface; ``queries`` registers the
thin ``opN_<name>`` queries.  Nothing else in the library imports this subpackage.
"""
