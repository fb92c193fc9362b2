"""Record analytics on Spark: typed normalisation, linkage, lifecycles, suppressed aggregates."""
