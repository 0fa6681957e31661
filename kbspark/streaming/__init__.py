"""Streaming of kbspark."""
