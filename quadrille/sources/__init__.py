"""sources of the quadrille engine."""
