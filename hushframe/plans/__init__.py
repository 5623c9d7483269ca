"""Registered queries and the SQL that checks them, by group.

A module holds ``QUERIES`` (name -> callable(spark, sf_dir)) and ``SQL``
(name -> statement over the same tables).
"""
