"""Registered queries over the test tables, each beside the SQL that checks it."""

from tablekeep.queries import artifacts, snapshots, tables

# name -> (query taking (spark, folder), SQL or None)
ALL = {**tables.QUERIES, **artifacts.QUERIES, **snapshots.QUERIES}
