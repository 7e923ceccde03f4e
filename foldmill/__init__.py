"""A PySpark engine that profiles, screens, encodes and compares large collections of text payloads."""
