"""Operators of a training-data pipeline. Nothing outside this subpackage imports it but ``__spark_entry__``."""
