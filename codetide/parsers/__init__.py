"""Structure of source files: classes, methods, functions and imports, by table functions."""
