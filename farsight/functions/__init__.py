"""Column functions: vector distances and filter predicates."""
