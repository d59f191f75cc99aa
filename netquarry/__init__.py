"""Flow-log, packet, retrieval and trajectory analytics on Spark DataFrames."""
