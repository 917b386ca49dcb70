"""Task functions are shipped by value in these tests, as in a run by the entry module."""

import __spark_entry__  # noqa: F401
