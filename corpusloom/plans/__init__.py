"""Composite plans: whole tables from sources to results."""
