"""Training-data operators: tokens, near-duplicates, language, packing, mixing, sharding, fingerprints, pages, archives.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
