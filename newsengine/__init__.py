"""News-event analytics and data-processing operators on Spark DataFrames."""
