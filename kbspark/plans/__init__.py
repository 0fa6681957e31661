"""Plans of kbspark."""
