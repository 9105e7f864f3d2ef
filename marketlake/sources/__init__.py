"""Reading, merging and writing tables."""
