"""Operators on DataFrames: projections, row sampling, features, joins of neighbours, learners."""
