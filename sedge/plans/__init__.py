"""plans of sedge."""
