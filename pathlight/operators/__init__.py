"""Graph operators over ``edges(src, dst)`` and ``nodes(id)`` DataFrames."""
