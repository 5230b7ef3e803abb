"""Registered queries: each operator run over the test tables, with its check SQL."""
