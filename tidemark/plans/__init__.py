"""Registered queries: operators applied to views over the given tables, with SQL for comparison."""
