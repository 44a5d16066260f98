"""chronoweave: temporal memory-graph analytics expressed as PySpark plans."""
