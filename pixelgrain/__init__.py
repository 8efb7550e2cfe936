"""Image quantification on Spark: rasters, masks, labels and measurements as DataFrames."""
