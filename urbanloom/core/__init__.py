"""Building blocks: window expressions, spatial joins, raster neighbours."""
