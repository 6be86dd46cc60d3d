"""veltrial: experiment analytics and causal measurement on PySpark."""
