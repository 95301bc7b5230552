"""Aggregation strategies as column builders."""
