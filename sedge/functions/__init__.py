"""functions of sedge."""
