"""Coverage analytics on Spark: interval algebra, depth, normalisation, panels, copy-ratio tracks, read upscaling."""
