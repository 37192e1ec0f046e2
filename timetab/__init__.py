"""timetab: leak-checked feature tables, time splits and model scoring on Spark DataFrames."""
