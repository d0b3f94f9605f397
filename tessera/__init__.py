"""Spark-native analytics: panel operators in `operators`, kernels in `functions`, jobs in `plans`."""
