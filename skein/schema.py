"""Index schemas: a fixed list of text, keyword and i64 fields."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

TEXT, KEYWORD, I64 = "text", "keyword", "i64"
SPARK_TYPES = {TEXT: T.StringType(), KEYWORD: T.StringType(), I64: T.LongType()}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    #: Kept for compatibility; the whole document is always stored.
    store: bool = True


@dataclass(frozen=True)
class IndexSchema:
    fields: tuple[Field, ...] = field(default_factory=tuple)
    id_field: str = ""

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        for f in self.fields:
            if names.count(f.name) > 1:
                raise ValueError(f"field {f.name!r} is declared twice")
            if f.type not in SPARK_TYPES:
                raise ValueError(f"field {f.name!r} has the unknown type {f.type!r}")
        if self.id_field and self.id_field not in names:
            raise ValueError(f"the id field {self.id_field!r} is not among the fields")

    @classmethod
    def of(cls, id_field: str = "", **types: str) -> IndexSchema:
        return cls(tuple(Field(n, t) for n, t in types.items()), id_field)

    @classmethod
    def from_json(cls, text: str) -> IndexSchema:
        raw = json.loads(text)
        return cls(tuple(Field(f["name"], f["type"], bool(f.get("store", False))) for f in raw.get("fields") or []), raw.get("id_field") or "")

    def to_json(self) -> str:
        out: dict = {"fields": [{"name": f.name, "type": f.type, "store": f.store} for f in self.fields]}
        return json.dumps(out | ({"id_field": self.id_field} if self.id_field else {}))

    def indexed(self) -> list[Field]:
        return [f for f in self.fields if f.type != I64]

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type]) for f in self.fields])
