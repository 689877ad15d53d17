"""Training-data operators: packing, quality, archives, privacy, mixing, search and near-duplicates.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
