"""operators of the quadrille engine."""
