"""Query plans over the shared test tables: one builder per operator, and the
equivalent DuckDB SQL for the oracle check."""
