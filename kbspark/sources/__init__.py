"""Sources of kbspark."""
