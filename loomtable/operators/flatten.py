"""Deterministic flattening of nested structs into wide tables.

Top-level columns that are no families come first, in their order; the leaf
fields of families follow as metrics, sorted by id.  A metric's id is its
family's prefix and the path inside, joined by underscores, or an id of its
own.  Options lie in the fields' metadata: prefix (a family), id, skip.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.errors import EngineError
from loomtable.formats import FLATTEN_GENERATION
from loomtable.spec import ColumnSpec, IndexSpec, TableSpec, _from_field, spark_identifier, validate_id
from loomtable.types import FieldType

_LEAVES = {T.StringType(): "Text", T.ShortType(): "SmallInt", T.IntegerType(): "Integer", T.LongType(): "BigInt", T.FloatType(): "Real", T.DoubleType(): "DoublePrecision", T.BooleanType(): "Boolean", T.BinaryType(): "Bytea", T.TimestampType(): "TimestampTz"}


class ValueVisitor(Protocol):
    def visit(self, column: str, kind: FieldType, value) -> None: ...


@dataclass(frozen=True)
class Leaf:
    id: str
    path: tuple[str, ...]
    type: FieldType
    nullable: bool


@dataclass(frozen=True)
class Flattened:
    """The plan of a struct type: columns in order, metrics and the hash of the schema."""

    processor_id: str
    provenance: tuple[ColumnSpec, ...]
    metrics: tuple[Leaf, ...]
    indexes: tuple[IndexSpec, ...] = ()
    generation: str = FLATTEN_GENERATION

    @property
    def columns(self) -> list[str]:
        return [c.name for c in self.provenance] + self.metric_columns

    @property
    def metric_columns(self) -> list[str]:
        return [m.id for m in self.metrics]

    @property
    def schema_hash(self) -> str:
        lines = [self.generation, self.processor_id, *(f"{m.id}:{m.type.name}:{int(m.nullable)}" for m in self.metrics)]
        return hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()

    def table_spec(self, name: str) -> TableSpec:
        wrong = [c for i in self.indexes for c in i.columns if c in self.metric_columns]
        if wrong:
            raise EngineError(f"metric columns can't be indexed: {wrong}")
        return TableSpec(name, (*self.provenance, *(ColumnSpec(m.id, m.type, m.nullable) for m in self.metrics)), self.indexes)

    def project(self, df: DataFrame) -> DataFrame:
        """One projection, whatever the number of columns."""
        own = [F.col(spark_identifier(c.name)) for c in self.provenance]
        return df.select(own + [F.col(".".join(map(spark_identifier, m.path))).alias(m.id) for m in self.metrics])

    def values(self, row: Row) -> Iterator[tuple[str, FieldType, object]]:
        for c in self.provenance:
            yield c.name, c.type, row[c.name]
        for m in self.metrics:
            value = row
            for p in m.path:
                value = value[p]
            yield m.id, m.type, value

    def visit(self, row: Row, visitor: ValueVisitor) -> None:
        for name, kind, value in self.values(row):
            visitor.visit(name, kind, value)


class ArgumentsVisitor:
    """Collects values in order, to be bound to an INSERT."""

    def __init__(self):
        self.arguments: list = []

    def visit(self, column: str, kind: FieldType, value) -> None:
        self.arguments.append(value)


def flatten(schema: T.StructType, processor_id: str, indexes: tuple[IndexSpec, ...] = ()) -> Flattened:
    validate_id(processor_id, "processor id")
    provenance: list[ColumnSpec] = []
    metrics: list[Leaf] = []
    for f in schema:
        meta = f.metadata or {}
        if meta.get("skip"):
            continue
        if not isinstance(f.dataType, T.StructType):
            if "prefix" in meta:
                raise EngineError(f"family {f.name} must be a struct")
            provenance.append(_from_field(f))
            continue
        if "prefix" not in meta:
            raise EngineError(f"the nested struct {f.name} needs a family prefix")
        validate_id(meta["prefix"], "family prefix")
        if f.nullable:
            raise EngineError(f"the family struct {f.name} must not be optional")
        metrics += _leaves(f.dataType, meta["prefix"], (f.name,), ())
    if not provenance and not metrics:
        raise EngineError("the flattened schema has no columns")
    metrics.sort(key=lambda m: m.id)
    seen: set[str] = {c.name for c in provenance}
    if len(seen) < len(provenance):
        raise EngineError("column id collision among provenance columns")
    for m in metrics:
        if m.id in seen:
            raise EngineError(f"column id collision: {m.id}")
        seen.add(m.id)
    return Flattened(processor_id, tuple(provenance), tuple(metrics), indexes)


def _leaves(struct: T.StructType, prefix: str, path: tuple[str, ...], inside: tuple[str, ...]) -> list[Leaf]:
    out: list[Leaf] = []
    for f in struct:
        meta = f.metadata or {}
        if meta.get("skip"):
            continue
        if isinstance(f.dataType, T.StructType):
            if f.nullable:
                raise EngineError(f"the nested struct {f.name} must not be optional")
            out += _leaves(f.dataType, prefix, (*path, f.name), (*inside, f.name))
            continue
        json_leaf = meta.get("type", "").upper() == "JSONB"
        if f.dataType not in _LEAVES:
            raise EngineError(f"unsupported leaf type {f.dataType.simpleString()} of {f.name}")
        name = prefix + "_".join((*inside, meta.get("id", f.name)))
        out.append(Leaf(validate_id(name, "metric id"), (*path, f.name), FieldType("Jsonb" if json_leaf else "Uuid" if meta.get("type") == "UUID" else _LEAVES[f.dataType]), f.nullable))
    return out
