"""Column expressions and one-pass aggregates: text, distances, metrics, scores, statistics."""
