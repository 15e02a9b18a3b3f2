"""Operators of a training-data pipeline over document tables.

Each module states what it does with nulls, empty and very long texts, ties and
repeated rows. Inputs may carry any further columns; operators read the named ones only.
"""
