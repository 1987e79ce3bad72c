"""Loomspark: corpus preparation on Spark DataFrames.

Sub-packages: ``sources`` (tables, directory scan, bounded reads), ``functions`` (column expressions),
``operators`` (DataFrame to DataFrame), ``plans`` (registered queries and their SQL), ``streaming``.
``llm`` holds the training-text operators; nothing outside that folder imports it.
"""

__version__ = "0.1.0"
