"""Analytics over tri-temporal property graphs, as Spark DataFrames.

Nodes and edges carry a story interval (when something holds), a reveal time (when a reader
learns it) and a transaction interval (when the graph believed it).  Operators take whole
tables of questions and return DataFrames.
"""
