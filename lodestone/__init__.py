"""Lodestone: procurement-notice analytics and corpus operators on Spark DataFrames."""
