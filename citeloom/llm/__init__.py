"""Training-data operators: tokenising, sharding, filtering, searching and formatting corpora.

Nothing outside this subpackage imports it.
"""
