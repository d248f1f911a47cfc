"""Nothing streams here: the engine clusters a whole table of vectors at a time.

A stream of vectors is clustered by writing it to a table and running the batch plan on it.
"""
