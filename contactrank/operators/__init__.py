"""Operators over contacts and portfolio tables."""
