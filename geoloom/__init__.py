"""geoloom: keyed tables, gridded rasters and geometry as declarative Spark jobs."""
