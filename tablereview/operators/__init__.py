"""One module per stage of a dataset review."""
