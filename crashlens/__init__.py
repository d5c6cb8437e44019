"""crashlens: road-accident harmonisation and analysis on Spark.

Subpackages: ``functions`` (column expressions and fixed code lists),
``sources`` (files, fixtures, twilight dimension), ``operators`` (normalise,
quality, joins, night, stats), ``plans`` (the stage chain and the composed
analyses), ``streaming`` (the row-wise stages on a stream).
"""

__version__ = "0.1.0"
