"""Column functions: strings, paths, documentation quality, and the fixed word tables."""
