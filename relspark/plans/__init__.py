"""From programs to DataFrames."""
