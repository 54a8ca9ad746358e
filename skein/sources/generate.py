"""Synthetic energy-market messages, made by seeded expressions in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("UTILMD", "APERAK", "MSCONS", "UTILTS", "PRICAT", "INVOIC", "REMADV", "CONTRL")
WITH_LOCATION = ("UTILMD", "MSCONS", "UTILTS")
PARTICIPANTS = 60
LOCATIONS = 200
FIRST_MS, LAST_MS = 1_672_531_200_000, 1_798_761_599_999  # 2023 to 2026
TEXTS = ("Zählpunkt ist dem Gerät nicht zugeordnet", "Ungültiges Datum der Ablesung", "Lieferbeginn geändert", "Prüfung ohne Beanstandung")


def messages(spark: SparkSession, n: int, kind: str | None = None, seed: int = 1) -> DataFrame:
    """n rows (raw, message_type, sender_id, receiver_id, interchange_ref, bgm_ref, location, ts); the same for the same seed."""
    if kind is not None and kind not in TYPES:
        raise ValueError(f"there is no message type {kind!r}")

    def draw(what: str, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(below))

    def party(number: Column) -> Column:
        return F.concat(F.lit("99"), F.lpad((F.pmod(F.xxhash64(F.lit(seed), F.lit("party"), number), F.lit(10**11))).cast("string"), 11, "0"))

    def place(number: Column) -> Column:
        digits = F.lpad(F.pmod(F.xxhash64(F.lit(seed), F.lit("place"), number), F.lit(10**15)).cast("string"), 31, "0")
        return F.concat(F.lit("DE"), digits)

    d = spark.range(n)
    types = F.array(*[F.lit(t) for t in ((kind,) if kind else TYPES)])
    d = d.withColumns({
        "message_type": F.element_at(types, (draw("type", len(TYPES) if not kind else 1) + 1).cast("int")),
        "s": draw("sender", PARTICIPANTS), "shift": draw("receiver", PARTICIPANTS - 1) + 1,
        "ts": F.lit(FIRST_MS) + draw("ts", LAST_MS - FIRST_MS + 1),
        "reference": F.lpad((draw("rff", 999_999) + 1).cast("string"), 6, "0"),
        "number": (draw("message", 900_000) + 100_000).cast("string"),
        "inner": place(draw("inner", LOCATIONS)), "outer": place(draw("outer", LOCATIONS)),
        "amount": F.format_string("%d.%03d", draw("amount", 5000), draw("thousandth", 1000)),
        "text": F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (draw("text", len(TEXTS)) + 1).cast("int")),
    })
    d = d.withColumns({"sender_id": party(F.col("s")), "receiver_id": party(F.pmod(F.col("s") + F.col("shift"), F.lit(PARTICIPANTS)))})
    when = F.timestamp_millis("ts")
    d = d.withColumns({"day": F.date_format(when, "yyMMdd"), "minute": F.date_format(when, "HHmm"), "interchange_ref": F.concat(F.date_format(when, "yyMMddHHmm"), F.lpad(draw("ref", 10_000).cast("string"), 4, "0"))})
    d = d.withColumn("bgm_ref", F.concat(F.substring("interchange_ref", 1, 10), F.lpad(draw("bgm", 10**6).cast("string"), 6, "0")))
    body = {
        "UTILMD": ["IDE+24+{reference}'", "LOC+172+{inner}'", "RFF+Z13:{reference}'"], "APERAK": ["ERC+Z10'", "FTX+ABO+++{text}'", "RFF+ACE:{reference}'"],
        "MSCONS": ["LOC+172+{inner}'", "QTY+220:{amount}'", "RFF+Z13:{reference}'"], "UTILTS": ["LOC+237+{inner}'", "SEQ+Z36+1'"],
        "PRICAT": ["LIN+1'", "PRI+CAL:{amount}'"], "INVOIC": ["MOA+9:{amount}'", "TAX+7+VAT'"], "REMADV": ["DOC+380+{reference}'", "MOA+12:{amount}'"], "CONTRL": ["UCI+{interchange_ref}+{sender_id}'"],
    }

    def filled(line: str) -> Column:
        parts = []
        for piece in line.replace("}", "{").split("{"):
            parts.append(F.col(piece).cast("string") if len(parts) % 2 else F.lit(piece))
        return F.concat(*parts)

    head = ["UNB+UNOC:3+{sender_id}:500+{receiver_id}:500+{day}:{minute}+{interchange_ref}'", "UNH+{number}+{message_type}:D:11A:UN'", "BGM+E01+{bgm_ref}'", "NAD+MS+{sender_id}::293'", "NAD+MR+{receiver_id}::293'"]
    tail = ["UNT+9+{number}'", "UNZ+1+{interchange_ref}'"]
    raw = F.lit(None).cast("string")
    for t, inner in body.items():
        raw = F.when(F.col("message_type") == t, F.concat_ws("\n", *[filled(x) for x in head + inner + tail])).otherwise(raw)
    location = F.when(F.col("message_type").isin(*WITH_LOCATION), F.col("outer"))
    return d.select(raw.alias("raw"), "message_type", "sender_id", "receiver_id", "interchange_ref", "bgm_ref", location.alias("location"), "ts")


def ndjson(messages: DataFrame) -> DataFrame:
    """(value): the messages as JSON lines, without absent fields."""
    return messages.select(F.to_json(F.struct(*messages.columns)).alias("value"))
