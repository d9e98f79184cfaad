"""geoloom: raster and vector analytics as Spark DataFrames."""
