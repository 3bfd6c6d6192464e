"""Analytics over per-frame, per-object observation tables, built on Spark DataFrames."""
