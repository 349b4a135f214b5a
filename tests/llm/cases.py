"""Small tables with the awkward cases that every operator has to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Names that operators use inside; inputs may have such columns too.
CLASHING = ("id", "n", "set_id", "score", "kept", "items", "spans", "label", "start", "part", "first", "starts", "h", "key",
            "value", "digest", "payload", "bucket", "block", "grp", "run", "all_size", "component", "norm", "sha")
LONG = " ".join(f"w{i % 977}x{i % 7}" for i in range(30_000))


def with_clashes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING if c not in df.columns})


def documents(spark) -> DataFrame:
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base), (2, base), (2, base), (3, f"  {base}"), (4, base.replace(" ", "\t\n", 3)), (5, None), (6, ""), (7, " \n\t "),
        (8, LONG), (9, LONG), (10, "short"), (11, "SHORT"), (12, "Ünïcode ÄÖ 日本 \U0001f600 \x00 x"), (None, base), (None, None),
        (13, f"{base} thirteen fourteen"), (14, "a b c d e"), (15, "a b c d e "), (-3, "a b c d e"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return with_clashes(df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")}))


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
