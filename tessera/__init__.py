"""Analytics on Spark over records, embeddings, edges and their history, and over training data."""
