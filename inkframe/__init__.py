"""Page-oriented documents and rasters as DataFrames."""
