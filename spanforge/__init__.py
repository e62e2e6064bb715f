"""A code-graph query engine on DataFrames."""
