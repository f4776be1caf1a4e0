"""Operators for building training corpora: near-duplicate joins, token counts, secret scans, packing, archives,
quality rules and classifiers, exact vector search, byte-level BPE and chat formatting."""
