"""Catalog change tracking as Spark jobs: snapshots in, state and change logs out."""
