"""Reading, validating and writing the tables."""
