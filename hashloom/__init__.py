"""hashloom: hierarchical fingerprints, component matching and corpus work on Spark."""
