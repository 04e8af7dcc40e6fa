"""Price bars, conditions, rules and strategies on Spark DataFrames."""
