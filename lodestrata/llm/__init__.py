"""Training-data operators.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrame to DataFrame in a module of its own; ``queries`` holds the thin
``opN_<name>`` queries over the driver tables.
"""
