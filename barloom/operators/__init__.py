"""Operators on bars: building them, indicators, conditions, rules and strategies; and joins that Spark lacks."""
