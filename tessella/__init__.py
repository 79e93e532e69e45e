"""Image-mosaic analytics on Spark DataFrames."""
