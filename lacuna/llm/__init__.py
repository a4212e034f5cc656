"""Training-data operators: mixing, PII, line dedup, language ID, token counts, code search, secrets,
BPE streaming, n-gram Jaccard join and embedding near-dedup. Nothing else in the library imports this."""
