"""Territorial and socioeconomic analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames to a DataFrame. Nothing is
collected while a plan is being built, with the exceptions named in the
docstrings of ``sources`` (reading one header line) and ``operators.spatial``
(fitting cluster centres).
"""

__version__ = "0.1.0"
