"""The registered queries: test tables seen as fund data, the queries on them and their SQL twins."""
