"""Space-time analytics on Spark: regularise, align, derive, detect and verify geophysical series as DataFrame plans."""
