"""Holidays that need no published calendar."""

# Fixed values: (month, day, occasion).
FIXED_NATIONAL_HOLIDAYS = [
    (1, 26, "Republic Day"),
    (5, 1, "Maharashtra Day / Labour Day"),
    (8, 15, "Independence Day"),
    (10, 2, "Gandhi Jayanti"),
    (12, 25, "Christmas Day"),
]

# Fixed value: the search for an open day gives up after this many days.
CLOSURE_SEARCH_DAYS = 60
