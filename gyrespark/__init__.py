"""gyrespark: vortex and track analytics as Spark DataFrame operators.

Every operator takes DataFrames plus column names and returns a DataFrame, so
the same code runs on gridded weather tables and on any table with a key, an
order and a value.
"""

__version__ = "0.1.0"
