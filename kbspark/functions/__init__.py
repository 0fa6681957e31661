"""Functions of kbspark."""
