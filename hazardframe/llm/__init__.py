"""Training-data operators: sharding, packing, deduplication, tokens, scoring.

Each module holds one operator with its own general interface; `queries`
derives the digest columns that the registered `opN_` queries return.
Nothing outside this subpackage imports it.
"""
