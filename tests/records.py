"""The example transactions that several tests share."""

from creditgrain.schema import TRANSACTIONS

# The ten-transaction example.
TEN = [
    (1, 101, 1001, 1, 2001, "KES", 254, 1, 10, "A", "Web", 100.0, 100.0, "2024-01-01", 0, 0),
    (2, 101, 1001, 1, 2001, "KES", 254, 2, 11, "B", "Android", 200.0, 200.0, "2024-01-05", 1, 0),
    (3, 102, 1002, 2, 2002, "USD", 1, 1, 20, "C", "IOS", -50.0, 50.0, "2024-01-10", 2, 1),
    (4, 103, 1001, 1, 2001, "KES", 254, 1, 10, "A", "Web", 150.0, 150.0, "2024-01-02", 0, 0),
    (5, 104, 1003, 3, 2003, "KES", 254, 3, 30, "D", "Web", 500.0, 500.0, "2024-01-15", 1, 0),
    (6, 105, 1002, 2, 2002, "USD", 1, 2, 21, "C", "IOS", -25.0, 25.0, "2024-01-12", 2, 0),
    (7, 106, 1004, 4, 2004, "KES", 254, 1, 10, "A", "Android", 75.0, 75.0, "2024-01-03", 0, 0),
    (8, 107, 1001, 1, 2001, "KES", 254, 2, 12, "B", "Web", 300.0, 300.0, "2024-01-06", 1, 0),
    (9, 108, 1003, 3, 2003, "KES", 254, 3, 31, "D", "Android", 120.0, 120.0, "2024-01-16", 2, 1),
    (10, 109, 1004, 4, 2004, "KES", 254, 1, 11, "B", "Web", 80.0, 80.0, "2024-01-04", 0, 0),
]


def records(rows=TEN):
    return [dict(zip(TRANSACTIONS.names, row, strict=True)) for row in rows]


def by_account(df):
    return {r["AccountId"]: r.asDict() for r in df.collect()}
