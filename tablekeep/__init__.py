"""Snapshots of table sets on Spark: take, check, list, rotate and restore them."""
