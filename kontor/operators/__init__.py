"""Relational operators that the plans share."""
