"""keyloom: key-range, version, catalog and metrics analytics as Spark DataFrame operators."""
