"""Bindings of the operators to the test tables, the registered queries, and the end-to-end jobs."""
