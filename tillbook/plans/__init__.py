"""The reports. Each takes a :class:`~tillbook.model.RetailModel` and returns a
lazy DataFrame. A selection left out means all, and its key column then stays in
the result.
"""
