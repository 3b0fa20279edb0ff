"""Registered queries of the core, by family, each with the SQL that gives the same rows where SQL can."""
