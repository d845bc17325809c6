"""Registered queries and the tables that feed them."""
