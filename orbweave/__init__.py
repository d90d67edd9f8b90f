"""Analytics over electronic-structure predictions, and corpus operators, on Spark DataFrames."""
