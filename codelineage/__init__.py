"""Code-provenance and change analytics as Spark DataFrame operators."""
