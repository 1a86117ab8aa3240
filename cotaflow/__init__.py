"""Fund-industry analytics on Spark DataFrames.

``functions`` hold column expressions, ``operators`` reusable DataFrame steps, ``sources`` reads and
writes, ``plans`` the finished analyses.  Every plan is lazy and takes and returns DataFrames.
"""
