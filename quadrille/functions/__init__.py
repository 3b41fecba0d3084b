"""functions of the quadrille engine."""
