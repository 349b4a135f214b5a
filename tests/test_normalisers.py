from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fiscalspark.functions import periods as P, text as X
from fiscalspark.sources import tree

CASES = [
    (X.parse_amount, "2 050 300 400,25", Decimal("2050300400.25")), (X.parse_amount, "-81 119,05", Decimal("-81119.05")),
    (X.parse_amount, "", None), (X.parse_amount, "1.2.3", None), (X.parse_amount, "12-34", None),
    (X.parse_amount, "0,125", Decimal("0.12")), (X.parse_amount, "0,135", Decimal("0.14")), (X.parse_amount, "5.", Decimal("5.00")),
    (P.parse_date, "01.09.2025", date(2025, 9, 1)), (P.parse_date, "2025-03-07 00:00:00.000", date(2025, 3, 7)),
    (P.parse_date, "7/3/2025", date(2025, 3, 7)), (P.parse_date, "31.02.2025", None), (P.parse_date, "not a date", None),
    (X.normalize_header, "Подтв. лимитов по БО 2025 год", "подтвлимитовпобо2025год"), (X.normalize_header, "﻿Ёж", "еж"),
    (X.normalize_code, "03.2.01.97002", "0320197002"), (X.normalize_code, " . ", None),
    (X.clean_text, "\xa0  текст\t", "текст"), (X.clean_text, "﻿", None),
    (P.file_name_date, "август2025.csv", date(2025, 8, 1)), (P.file_name_date, "x/на01022026.csv", date(2026, 2, 1)),
    (P.file_name_date, "Контракты и договора.csv", None), (P.file_name_date, "мая 2025.csv", None),
    (P.has_impossible_file_date, "на99992025.csv", True), (P.has_impossible_file_date, "на01022026.csv", False),
    (tree.source_group, "1. РЧБ/x.csv", "rchb"), (tree.source_group, "x/скк.csv", "control_example"),
    (tree.source_group, "x.csv", "unknown"),
]


@pytest.mark.parametrize("function, given, expected", CASES)
def test_normaliser(spark, function, given, expected):
    df = spark.createDataFrame([(given,)], "v string")
    assert df.select(function(F.col("v"))).first()[0] == expected
