"""Training-data operators: dedup, similarity joins, scoring, tokens, mixing and vector search."""
