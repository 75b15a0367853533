"""Lookups and scores over unbounded query input."""
