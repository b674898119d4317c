"""Reading, guarding, sampling and writing tables."""
