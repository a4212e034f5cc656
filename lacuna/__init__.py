"""White-space analytics over dated, owned and classified documents, on Spark."""
