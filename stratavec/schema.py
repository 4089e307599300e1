"""Collection schemas: declared fields, their validation and their Spark and JSON forms."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import AlreadyExists, InvalidArgument, NotFound
from .types import DataType, IndexParams, IndexType, spark_type


@dataclass
class Field:
    name: str
    type: DataType
    nullable: bool = False
    dimension: int = 0
    index: IndexParams | None = None

    def validate(self) -> None:
        if not self.name:
            raise InvalidArgument("a field needs a name")
        if self.type == DataType.UNDEFINED:
            raise InvalidArgument(f"field {self.name!r} needs a type")
        if self.type.is_vector and self.dimension <= 0:
            raise InvalidArgument(f"vector field {self.name!r} needs a dimension above 0")

    def index_type(self) -> IndexType:
        return self.index.TYPE if self.index else IndexType.UNDEFINED

    def to_spark(self) -> T.StructField:
        return T.StructField(self.name, spark_type(self.type), True, {"vtype": int(self.type), "dim": self.dimension, "nullable": self.nullable, "index": self.index.to_json() if self.index else {}})

    def to_json(self) -> dict:
        return {"name": self.name, "data_type": int(self.type), "nullable": self.nullable, "dimension": self.dimension, "index": self.index.to_json() if self.index else None}

    @staticmethod
    def from_json(x: dict) -> Field:
        return Field(x["name"], DataType(x["data_type"]), x["nullable"], x["dimension"], IndexParams.from_json(x.get("index")))


@dataclass
class CollectionSchema:
    name: str
    fields: list[Field] = field(default_factory=list)
    max_docs_per_segment: int = 10_000_000

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise NotFound(f"no field {name!r}")

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def add(self, new: Field) -> CollectionSchema:
        new.validate()
        if new.name in self:
            raise AlreadyExists(f"field {new.name!r}")
        return replace(self, fields=[*self.fields, new])

    def drop(self, name: str) -> CollectionSchema:
        self[name]
        return replace(self, fields=[f for f in self.fields if f.name != name])

    def alter(self, old: str, new: str = "", to: Field | None = None) -> CollectionSchema:
        was = self[old]
        new = new or old
        if new != old and new in self:
            raise AlreadyExists(f"field {new!r}")
        now = replace(to or was, name=new)
        now.validate()
        return replace(self, fields=[now if f.name == old else f for f in self.fields])

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def vectors(self) -> list[Field]:
        return [f for f in self.fields if f.type.is_vector]

    def forward(self) -> list[Field]:
        return [f for f in self.fields if not f.type.is_vector]

    def forward_indexed(self) -> list[Field]:
        return [f for f in self.forward() if f.index]

    def with_index(self, kind: IndexType) -> list[Field]:
        return [f for f in self.fields if f.index_type() == kind]

    def has_index(self, name: str) -> bool:
        return name in self and self[name].index is not None

    def to_spark(self) -> T.StructType:
        """id, then the fields."""
        return T.StructType([T.StructField("id", T.StringType(), True), *[f.to_spark() for f in self.fields]])

    def to_json(self) -> dict:
        return {"name": self.name, "fields": [f.to_json() for f in self.fields], "max_docs_per_segment": self.max_docs_per_segment}

    @staticmethod
    def from_json(x: dict) -> CollectionSchema:
        return CollectionSchema(x["name"], [Field.from_json(f) for f in x["fields"]], x["max_docs_per_segment"])
