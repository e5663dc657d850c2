"""Spark-native raster-to-vector analytics; see README.md."""
