"""Continuous modes: watching a tree of files, and activity windows over event streams."""
