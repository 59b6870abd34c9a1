"""Column functions: JSON pointers, bindings, conditions, comparisons, prices."""
