"""Catalog planning: routes, topics, replication, access, configuration."""
