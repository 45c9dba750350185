"""Data packaging jobs on Spark: read, cast, partition, describe and serve messy tables."""
