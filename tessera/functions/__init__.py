"""Column functions: the total order of values, similarity, text relevance."""
