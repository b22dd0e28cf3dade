"""Queries over the supplied tables, one for each operator, with DuckDB SQL that says the same."""
