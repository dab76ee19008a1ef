"""Training-data pipeline operators (ten of them) and their queries.

Nothing else in the package imports this subpackage.
"""
