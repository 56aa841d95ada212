"""numpy kernels without Spark."""
