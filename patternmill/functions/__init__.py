"""Values, conversions and built-in functions, for Python and for Spark columns."""
