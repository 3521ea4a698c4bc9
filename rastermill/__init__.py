"""Raster and material-map analytics on Spark: ``DataFrame -> DataFrame`` operators."""
