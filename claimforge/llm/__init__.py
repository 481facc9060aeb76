"""Training-data operators: dedup, packing, filtering, mixing and scans over document tables."""
