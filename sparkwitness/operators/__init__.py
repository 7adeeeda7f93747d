"""Table operators, one module per family."""
