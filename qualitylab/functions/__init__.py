"""Column-level functions: ``Column -> Column``, no shuffles, no Python workers."""
