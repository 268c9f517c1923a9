"""geoloom: geographic and text analytics as Spark DataFrames."""
