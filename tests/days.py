"""Dates of the tests, counted from a fixed day."""

import datetime as dt

DAY0 = dt.date(2021, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)
