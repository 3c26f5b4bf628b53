"""Spark-native collation of text versions: blocks, alignment, word differences, metrics, exports."""
