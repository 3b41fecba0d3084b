"""plans of the quadrille engine."""
