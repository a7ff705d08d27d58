"""Whole jobs put together from the operators, and the queries over the test tables."""
