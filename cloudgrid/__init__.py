"""cloudgrid: point clouds and what derives from them, on Spark DataFrames."""
