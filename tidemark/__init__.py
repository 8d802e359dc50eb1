"""Point-in-time analytics over mixed-frequency time series, as Spark plans."""
