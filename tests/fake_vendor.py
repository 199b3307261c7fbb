"""A vendor for tests: two contracts a day and instrument, whose trade moves from the first to the second."""

import os
import uuid
from datetime import date, datetime, timedelta


def noted(*what):
    if os.environ.get("FAKE_VENDOR_LOG"):
        with open(os.path.join(os.environ["FAKE_VENDOR_LOG"], uuid.uuid4().hex), "w") as f:
            f.write(" ".join(map(str, what)))


def rows(instrument, first, last):
    turn = date(2024, 1, 10) + timedelta(3 * (ord(instrument[0]) % 5))
    for k in range((last - first).days + 1):
        d = first + timedelta(k)
        for m in (1, 2):
            yield (datetime(d.year, d.month, d.day), f"{instrument}{m}", 100.0 + m + len(instrument), 101.0, 99.0, 100.0, 100.0, 10.0 * (m == (2 if d >= turn else 1)) + 1, 5.0)


def fetch(instrument, first, last):
    noted(instrument, first, last)
    # more than asked for, as vendors do
    return rows(instrument, first - timedelta(2), last)


def failing(instrument, first, last):
    noted("try", instrument)
    if instrument == "B":
        raise OSError("no answer")
    names = ("time", "symbol", "open", "high", "low", "close", "settle", "volume", "position")
    return (dict(zip(names, r, strict=True)) for r in rows(instrument, first, last))
