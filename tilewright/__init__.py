"""A Spark-native engine for tile selection, raster analytics and training-data preparation."""
