"""Column functions: expressions over columns, no DataFrames."""
