"""Registered queries of the subpackage; each module has QUERIES and ORACLES."""
