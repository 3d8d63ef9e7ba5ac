"""Time-series operators: DataFrame in, DataFrame out, for all series of a table at once."""
