"""Evidence analytics on Spark: ranked retrieval, document structure, sufficiency and governance."""
