"""Ready-made jobs over the operators."""
