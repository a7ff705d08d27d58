"""Operators over DataFrames: joins, running values, link graph, results, jobs, delivery."""
