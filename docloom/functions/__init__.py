"""Column functions: text, adaptive parameters, scores, tables."""
