"""Spark-native document and entity analytics: selectors, rewrite rules, tree flattening, joins, rollups."""
