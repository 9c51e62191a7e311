"""A static checker of program cells: does a named column, key or file provably not exist?

`interpreter.decide` judges one cell, `replay.replay` folds it over traces.
"""
