"""Generated frames of set shapes, the same for the same seed: what benchmarks write and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DATASETS = ("mixed", "wide", "strings-unique", "numeric")
NULL_SHARE, LONG_SHARE = 10, 100  # one in so many


def draw(seed: int, *key) -> Column:
    """A whole number from 0 to 2**32 - 1 that the seed and the key's columns or texts decide."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def xorshift32(state: Column) -> Column:
    """The state after this one, of the generator with shifts 13, 17 and 5."""
    word = F.lit(0xFFFFFFFF)
    state = state.cast("long")
    state = state.bitwiseXOR(F.shiftleft(state, 13)).bitwiseAND(word)
    state = state.bitwiseXOR(F.shiftrightunsigned(state, 17))
    return state.bitwiseXOR(F.shiftleft(state, 5)).bitwiseAND(word)


def _text(seed: int, row: Column, column: int, most: int = 30, least: int = 5) -> Column:
    long = F.concat(*[F.md5(F.concat_ws(":", F.lit(f"{seed}:{column}:{k}"), row.cast("string"))) for k in range(1 + most // 33)])
    return F.substring(long, F.lit(1), (least + draw(seed, row, f"len{column}") % (most - least + 1)).cast("int"))


def _moment(seed: int, row: Column, key: str, whole_days: bool = False) -> Column:
    second = draw(seed, row, key) % 315_360_000
    return F.timestamp_seconds(1_420_070_400 + (second - second % 86_400 if whole_days else second)).cast("timestamp_ntz")


def dataset(spark: SparkSession, name: str, rows: int, seed: int = 20260911) -> DataFrame:
    """One of DATASETS: ``mixed`` (20 columns of every kind, a tenth null, some texts past a cell's limit), ``wide``
    (107 columns), ``strings-unique`` (20 columns of texts that are all different) or ``numeric`` (20 columns)."""
    k = F.col("id")
    base = spark.range(rows)
    decimal = lambda key, most, places: (draw(seed, k, key) % (most * 10**places)) / 10**places
    if name == "numeric":
        return base.select(*[(draw(seed, k, c) % 1_000_001).cast("double").alias(f"Int_{c + 1:02d}") for c in range(10)],
            *[decimal(c, 1_000_000, 4).alias(f"Dec_{c - 9:02d}") for c in range(10, 20)])
    if name == "strings-unique":
        unique = lambda c: F.concat(F.lpad(F.lower(F.conv(k.cast("string"), 10, 36)), 6, "0"), F.lit("0123456789abcdefghij"[c]),
            F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{c}"), k.cast("string"))), 1, 17))
        return base.select(*[unique(c).alias(f"Key_{c + 1:02d}") for c in range(20)])
    if name == "wide":
        texts = [_text(seed, k, c).alias(f"Text_{c + 1:02d}") for c in range(60)]
        numbers = [((draw(seed, k, c) % 1_000_001).cast("double") if c % 2 == 0 else decimal(c, 100_000, 4)).alias(f"Num_{c - 59:02d}") for c in range(60, 90)]
        dates = [_moment(seed, k, str(c)).alias(f"Date_{c - 89:02d}") for c in range(90, 100)]
        return base.select(*texts, *numbers, *dates, *[(draw(seed, k, c) % 2 == 0).alias(f"Flag_{c - 99:02d}") for c in range(100, 107)])
    if name != "mixed":
        raise ValueError(f"{name} is none of {DATASETS}")
    number = lambda key, most: (draw(seed, k, key) % (most + 1)).cast("double")
    record = F.concat(F.lit('{"Email": "'), _text(seed, k, 50, 20), F.lit('@example.com", "Title": "'), _text(seed, k, 51, 60), F.lit('"}'))
    blob = F.concat(F.lit('{"done": true, "records": ['), F.repeat(F.concat(record, F.lit(", ")), F.when(draw(seed, k, "long") % LONG_SHARE == 0,
        400).otherwise((draw(seed, k, "records") % 4).cast("int"))), record, F.lit("]}"))
    columns = {
        "Name": _text(seed, k, 1), "AccountNumber": F.concat(F.lit("ACC-"), F.lpad((k + 1).cast("string"), 8, "0")),
            "Amount": decimal("amount", 1_000_000, 2), "Quantity": number("quantity", 10_000),
        "Probability": decimal("probability", 100, 1), "IsActive": draw(seed, k, "active") % 2 == 0, "IsDeleted": draw(seed, k, "deleted") % 20 == 0,
            "CreatedDate": _moment(seed, k, "created"),
        "LastModifiedDate": F.date_format(_moment(seed, k, "modified"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "CloseDate": _moment(seed, k, "close", True),
            "Description": F.concat_ws("\n", *[_text(seed, k, 60 + c, 200, 60) for c in range(4)]),
        "Contacts__r": blob, "Owner.Name": _text(seed, k, 2),
            "Owner.Id": F.concat(F.lit("005"), F.substring(F.md5((k + seed).cast("string")), 1, 15)),
            "Type": F.concat(F.lit("Type "), (draw(seed, k, "type") % 5).cast("string")),
        "Industry": F.concat(F.lit("Industry "), (draw(seed, k, "industry") % 12).cast("string")),
            "Website": F.concat(F.lit("https://www."), _text(seed, k, 3, 12), F.lit(".example.com")),
            "AnnualRevenue": number("revenue", 4_000_000_000), "NumberOfEmployees": number("employees", 250_000),
    }
    some = [F.when(draw(seed, k, f"null{n}") % NULL_SHARE > 0, c).alias(n) for n, c in columns.items()]
    return base.select(F.concat(F.lit("001"), F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"))), 1, 15)).alias("Id"), *some)
