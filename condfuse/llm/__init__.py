"""Operators for training-data corpora: mixing, archives, deduplication, sharding, secret scans,
language identification and packing.  Nothing outside this folder and ``corpus_pipeline.py``
imports it; ``queries.py`` lists the registered queries."""
