"""Quadrille: a Spark-native engine for querying RDF quads and the tables behind them."""
