"""Spark-native disease-burden attribution and valuation.

``sources`` read the inputs, ``functions`` hold Column and DataFrame helpers,
``operators`` are the steps of the analysis, ``plans`` chain them into the
published tables, and ``workload`` binds them to the driver's tables.
"""
