"""A product-catalogue engine on Spark DataFrames."""
