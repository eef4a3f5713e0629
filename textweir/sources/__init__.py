"""Reading, checking and writing command logs and results."""
