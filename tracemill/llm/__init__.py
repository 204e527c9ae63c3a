"""Operators that prepare text for training. Nothing else in the package imports this one."""
