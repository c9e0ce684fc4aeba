"""DataFrame operators.  Each function takes and returns DataFrames/Columns."""
