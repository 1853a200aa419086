"""Rows of a DataFrame in a form that tests can compare."""


def records(df):
    """Rows as a sorted list of tuples (nulls first)."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])
