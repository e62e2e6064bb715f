"""Set operations over the graph tables, as DataFrame plans."""
