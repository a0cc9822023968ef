"""Signal-to-sequence analytics on Spark: from multi-channel intensities to called bases and calibrated qualities."""
