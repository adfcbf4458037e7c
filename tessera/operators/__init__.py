"""Retrieval, feedback, graph and temporal operators as DataFrame transformations."""
