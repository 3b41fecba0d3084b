"""streaming of the quadrille engine."""
