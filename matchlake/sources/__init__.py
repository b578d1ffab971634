"""Readers, table schemas, the table store and the adapters over the benchmark tables."""
