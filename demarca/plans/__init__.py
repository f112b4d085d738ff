"""Finished analytic results, composed from the operators.

Each function takes the cleaned tables it needs and returns one result. Column
names follow the published tables.
"""
