"""Registered queries of the core engine; every module has QUERIES and ORACLES."""
