"""Operators for training-data pipelines: de-duplication, classification, tokenising, packing, formatting and search.

Nothing outside this subpackage imports it. Each module is one operator; ``queries`` holds the registered queries and their SQL.
"""
