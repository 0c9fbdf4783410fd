"""String similarity joins under token rewrite rules, on Spark DataFrames."""
