"""Point-in-time analytics on Spark: two-clock windows, as-of snapshots, panels and their evaluation."""
