"""scorewise.sources."""
