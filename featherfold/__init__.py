"""featherfold: tabular feature engineering and score modelling on Spark DataFrames."""
