"""Registered queries, by part of the inventory."""
