"""Relational, graph and retrieval operators over DataFrames."""
