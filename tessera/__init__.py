"""tessera: code-graph analytics and data processing written for Spark.

Every operator takes and returns DataFrames.  The subpackage ``llm`` holds
the training-data operators; nothing outside it imports it.
"""
