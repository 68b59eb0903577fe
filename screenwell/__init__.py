"""Screening analytics on Spark: scans, scoring columns, joins, similarity, rewards, streams."""
