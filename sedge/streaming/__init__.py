"""streaming of sedge."""
