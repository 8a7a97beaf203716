"""Kvasir: a Spark-native retrieval and knowledge-graph analytics engine.

Every operator is a function from DataFrames to a DataFrame; plans are declared
with the DataFrame/SQL API and left to Catalyst and AQE.
"""

__version__ = "0.1.0"
