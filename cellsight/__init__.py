"""Area evidence analytics on Spark: cells, polygons, runs and evidence as DataFrames."""
