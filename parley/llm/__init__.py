"""Training-data operators: exact top-k search, document fingerprints,
packing, source mixing, archive revisits, n-gram joins, language
identification, repeated-substring removal, personal data, token rollups,
ring shards, periodic runs, Merkle manifests.

Nothing outside this package and ``corpus_pipeline`` imports it.
"""
