"""Bindings of the domain tables, the registered queries and their SQL checks."""
