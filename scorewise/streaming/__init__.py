"""scorewise.streaming."""
