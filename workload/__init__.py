"""Check queries over the given tables, each with the DuckDB SQL that must give the same rows."""
