"""scorewise.operators."""
