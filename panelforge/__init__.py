"""panelforge: longitudinal, spatial and evaluation analytics as lazy PySpark DataFrames."""

__version__ = "0.1.0"
