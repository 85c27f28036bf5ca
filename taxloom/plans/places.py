"""States by the first two digits of a registration, and the High Court of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, state, High Court.
PLACES = [
    ("01", "Jammu and Kashmir", "High Court of Jammu & Kashmir and Ladakh"),
    ("02", "Himachal Pradesh", "Himachal Pradesh High Court"),
    ("03", "Punjab", "Punjab and Haryana High Court"),
    ("04", "Chandigarh", "Punjab and Haryana High Court"),
    ("05", "Uttarakhand", "Uttarakhand High Court"),
    ("06", "Haryana", "Punjab and Haryana High Court"),
    ("07", "Delhi", "Delhi High Court"),
    ("08", "Rajasthan", "Rajasthan High Court"),
    ("09", "Uttar Pradesh", "Allahabad High Court"),
    ("10", "Bihar", "Patna High Court"),
    ("11", "Sikkim", "Sikkim High Court"),
    ("12", "Arunachal Pradesh", "Gauhati High Court"),
    ("13", "Nagaland", "Gauhati High Court"),
    ("14", "Manipur", "Manipur High Court"),
    ("15", "Mizoram", "Gauhati High Court"),
    ("16", "Tripura", "Tripura High Court"),
    ("17", "Meghalaya", "Meghalaya High Court"),
    ("18", "Assam", "Gauhati High Court"),
    ("19", "West Bengal", "Calcutta High Court"),
    ("20", "Jharkhand", "Jharkhand High Court"),
    ("21", "Odisha", "Orissa High Court"),
    ("22", "Chhattisgarh", "Chhattisgarh High Court"),
    ("23", "Madhya Pradesh", "Madhya Pradesh High Court"),
    ("24", "Gujarat", "Gujarat High Court"),
    ("26", "Dadra and Nagar Haveli and Daman and Diu", "Bombay High Court"),
    ("27", "Maharashtra", "Bombay High Court"),
    ("29", "Karnataka", "High Court of Karnataka"),
    ("30", "Goa", "Bombay High Court (Goa Bench)"),
    ("31", "Lakshadweep", "Kerala High Court"),
    ("32", "Kerala", "Kerala High Court"),
    ("33", "Tamil Nadu", "Madras High Court"),
    ("34", "Puducherry", "Madras High Court"),
    ("35", "Andaman and Nicobar Islands", "Calcutta High Court"),
    ("36", "Telangana", "High Court for the State of Telangana"),
    ("37", "Andhra Pradesh", "High Court of Andhra Pradesh"),
    ("38", "Ladakh", "High Court of Jammu & Kashmir and Ladakh"),
]


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLACES, "code string, state string, high_court string")
