"""Sources of vectors and queries, and layouts that searches can read."""
