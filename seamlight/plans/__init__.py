"""Registered queries: each an engine call beside the SQL it is held against."""
