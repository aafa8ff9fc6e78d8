"""Column functions: every one is a Catalyst expression, without Python at run time."""
