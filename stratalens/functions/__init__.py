"""Column functions: text rules and content-addressed keys."""
