"""Training-data operators: ten distributed operators over text, vectors and dialogues.

Each module holds one operator with a general interface, and a thin query over the
standard tables.  ``catalog`` collects the queries for the driver.
"""
