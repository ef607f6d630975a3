"""Training-data operators: ten corpus transformations that scale with the cluster, not with the driver.

Nothing else in the library imports this subpackage.
"""
