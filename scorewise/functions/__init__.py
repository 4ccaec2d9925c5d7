"""scorewise.functions."""
