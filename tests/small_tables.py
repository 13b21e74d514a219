"""Small tables of text cells for the tests; what to expect of them is taken with pandas."""

import pandas as pd

STATIONS = (
    ("id", "place", "height", "temp", "wind", "terrain", "seen", "code"),
    [
        ("1", "Cape North", "12", "8.5", "31", "Coast", "2023-05-01", "K-10"),
        ("2", "high pass", "", "-3.1", "40", "Ridge", "2023-05-01", ""),
        ("3", "Old  Mill", "140", "", "12", "Valley", "2023-05-02", "K-12"),
        ("4", "SALT FLATS", "95", "19.4", "22", "Valley", "", "K-13"),
        ("5", "pine gate", "610", "7.7", "18", "Ridge", "2023-05-03", "K-14"),
        ("6", "Ferry N/A", "null", "11.2", "N/A", "Coast", "2023-05-03", ""),
        ("2", "high pass", "", "-3.1", "40", "Ridge", "2023-05-01", ""),
        ("7", "Stone Weir", "205", "10.1", "14", "Valley", "2023-05-04", "K-16"),
        ("8", "glass lake", "8700", "9.0", "16", "Valley", "2023-05-05", ""),
        ("9", "Long Beach", "3", "", "27", "Coast", "2023-05-06", "K-18"),
        ("10", "the notch", "480", "4.4", "-90", "Ridge", "2023-05-07", ""),
        ("11", "Barn Hill", "330", "6.4", "19", "Valley", "2023-05-08", "K-20"),
    ],
)
HARVEST = (
    ("lot", "farm", "crop", "crates", "price", "organic"),
    [
        ("h1", "Upper", "plums", "14", "8.25", "yes"),
        ("h2", "Lower", "pears", "9", "6.50", "no"),
        ("h3", "Upper", "plums", "22", "8.00", "yes"),
        ("h4", "Brook", "apples", "31", "4.75", "no"),
        ("h5", "Lower", "apples", "180", "4.50", "no"),
        ("h6", "Brook", "pears", "12", "6.90", "yes"),
        ("h7", "Brook", "apples", "27", "4.95", "no"),
        ("h8", "Lower", "plums", "17", "7.80", "yes"),
    ],
)
TABLES = {"stations": STATIONS, "harvest": HARVEST}
NUMERIC = {"stations": ["id", "height", "temp", "wind"], "harvest": ["crates", "price"]}


def small(spark, name):
    columns, rows = TABLES[name]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).coalesce(1)


def expected(name):
    """The table in pandas: null tokens are missing, numeric columns are numbers."""
    columns, rows = TABLES[name]
    table = pd.DataFrame(rows, columns=columns).replace(["", "null", "N/A"], None)
    return table.assign(**{c: table[c].astype(float) for c in NUMERIC[name]})


def iqr_fences(column):
    q1, q3 = column.quantile(0.25), column.quantile(0.75)
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
