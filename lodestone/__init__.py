"""Code-index analytics on Spark: typed tables, catalogue queries, graph, text, overlay and stream operators."""
