"""Operators of kbspark."""
