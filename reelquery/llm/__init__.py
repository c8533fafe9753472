"""Training-data operators: tokenising, formatting, search, cleaning, packing.

Nothing else in the library imports this subpackage.  Every operator takes
and returns DataFrames; `queries` binds them to the standard tables.
"""
