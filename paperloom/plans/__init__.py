"""Queries over the supplied tables, each with DuckDB SQL of the same meaning."""
