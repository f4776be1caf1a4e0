"""Evidence analytics on Spark: snapshots, resolution, traversal, freshness and lifecycle as DataFrame plans."""
