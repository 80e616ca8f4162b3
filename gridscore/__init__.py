"""gridscore: scoring, checking and ranking of evaluation grids with PySpark."""
