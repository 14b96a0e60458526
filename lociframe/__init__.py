"""DataFrame operators for genome-scale resistance and embedding analytics on Spark."""
