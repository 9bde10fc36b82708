"""Feature tables of the two problems: power demand per hour, and smoker yes/no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions import calendar, vectors
from murmuration.operators.clean import complete_rows, decode_label, first_rows, leading_features
from murmuration.operators.encode import assemble_features, one_hot_first_seen

DEMAND_COLUMNS = ["c0", "real_pow", "c2", "prog_pow", "ts"]
SMOKER_COLUMNS = [f"f{i:02d}" for i in range(68)] + ["label"]


def calendar_features(stamp: Column, last: Column) -> Column:
    """Seven weekday flags, six ten-minute flags and one number: fourteen features."""
    return F.concat(
        vectors.one_hot(calendar.iso_weekday(stamp), calendar.WEEKDAYS),
        vectors.one_hot(calendar.minute_slot(stamp), calendar.MINUTE_SLOTS),
        F.array(last.cast("double")),
    )


def demand_table(raw: DataFrame, limit: int | None = None, vocabulary: str = "calendar",
                 target: str = "real_pow") -> DataFrame:
    """``row_id, grp, x, y`` from the text cells of a demand file.

    ``grp`` is the clock hour as written, whatever the time zone of the session.  ``vocabulary='first_seen'`` numbers weekdays and minutes in order of
    appearance, as wide as the data; the default uses fixed calendar vocabularies.
    """
    rows = complete_rows(raw, [c for c in raw.columns if c != "row_id"])
    if limit is not None:
        rows = first_rows(rows, limit)
    stamped = rows.withColumn("at", F.col("ts").cast("timestamp_ntz"))
    number = F.col("prog_pow").cast("double")
    if vocabulary == "calendar":
        x = calendar_features(F.col("at"), number)
    else:
        stamped = stamped.withColumns({
            "weekday": calendar.weekday_name(F.to_date(calendar.day_text(F.col("ts")))),
            "minute": calendar.minute_text(calendar.time_text(F.col("ts"))),
        })
        x = vectors.append(
            F.concat(*[one_hot_first_seen(stamped, c, "row_id") for c in ("weekday", "minute")]), number
        )
    return stamped.select(
        "row_id", F.hour("at").alias("grp"), x.alias("x"), F.col(target).cast("double").alias("y")
    )


def labelled_table(raw: DataFrame, n_features: int = 68, limit: int | None = None) -> DataFrame:
    """``row_id, grp, x, y`` from text cells: ``n_features`` numbers, then a 0/1 label; one group."""
    rows = complete_rows(raw, [c for c in raw.columns if c != "row_id"])
    if limit is not None:
        rows = first_rows(rows, limit)
    x, label = leading_features(rows.drop("row_id"), n_features)
    return rows.select("row_id", F.lit(0).alias("grp"), x.alias("x"), decode_label(label).alias("y"))


def health_table(raw: DataFrame, label: str, hearing: tuple[str, str], caries: str, before: list[str],
                 after: list[str], order: str = "row_id") -> DataFrame:
    """Mixed table: one-hot of both hearing columns and caries, then two runs of numeric columns.

    Rows with a blank cell in one of these columns are left out before anything is counted.
    """
    used = [*hearing, caries, *before, *after, label]
    raw = complete_rows(raw.withColumns({c: F.col(c).cast("string") for c in used}), used)
    wide = assemble_features(raw, [*hearing, caries], [*before, *after], order)
    return wide.select(F.col(order).alias("row_id"), F.lit(0).alias("grp"), "x", decode_label(F.col(label)).alias("y"))
