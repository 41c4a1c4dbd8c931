"""Readers: CSV, JSON, JDBC, file inventory and chunked scans."""
