"""Table operators: DataFrame in, DataFrame out, lazily unless documented."""
