"""Pure Python kernels without Spark: what the column functions run per Arrow batch."""
