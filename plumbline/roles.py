"""Statistical roles of columns and the map of columns to roles."""

from __future__ import annotations

import json
from enum import Enum

from pyspark.sql import DataFrame, SparkSession


class Role(Enum):
    TARGET = "target"
    PREDICTOR = "predictor"
    IDENTIFIER = "identifier"
    WEIGHTING = "weighting"
    STRATIFIER = "stratifier"
    TREATMENT = "treatment"
    GEOMETRY = "geometry"
    SEQUENCE = "sequence"
    SENSITIVE = "sensitive"
    PARTITION = "partition"
    NONE = "none"

    @classmethod
    def of(cls, value) -> Role:
        """A role from itself or from its name in any case."""
        if isinstance(value, cls):
            return value
        if not isinstance(value, str):
            raise TypeError(f"a role is a Role or a string, not {type(value).__name__}")
        try:
            return cls(value.strip().lower())
        except ValueError:
            raise ValueError(f"unknown role: {value!r}") from None


class RoleMap:
    """Which roles each column has; a column may have several or none."""

    def __init__(self, roles: dict[str, set[Role]] | None = None):
        self.roles = {c: {Role.of(r) for r in rs} for c, rs in (roles or {}).items()}

    @classmethod
    def uniform(cls, columns, role: Role = Role.PREDICTOR) -> RoleMap:
        return cls({c: {role} for c in columns})

    def copy(self) -> RoleMap:
        return RoleMap(self.roles)

    def __eq__(self, other) -> bool:
        held = lambda m: {c: rs for c, rs in m.roles.items() if rs}
        return isinstance(other, RoleMap) and held(self) == held(other)

    __hash__ = None

    # changes

    def set(self, column: str, *roles) -> None:
        self.roles[column] = {Role.of(r) for r in roles}

    def add(self, column: str, role) -> None:
        self.roles.setdefault(column, set()).add(Role.of(role))

    def remove(self, column: str, role) -> None:
        """Take a role away; a column without roles leaves the map."""
        held = self.roles.get(column, set())
        held.discard(Role.of(role))
        if not held:
            self.roles.pop(column, None)

    def clear(self, column: str) -> None:
        self.roles.pop(column, None)

    def rename(self, old: str, new: str) -> None:
        if old != new:
            self.roles[new] = self.roles.pop(old)

    def renamed(self, names: dict[str, str]) -> RoleMap:
        """All renames at once, so that two names may be swapped."""
        return RoleMap({names.get(c, c): rs for c, rs in self.roles.items()})

    def restricted(self, columns) -> RoleMap:
        return RoleMap({c: rs for c, rs in self.roles.items() if c in set(columns)})

    # queries

    def get(self, column: str) -> set[Role]:
        return set(self.roles.get(column, set()))

    def columns_with(self, role) -> list[str]:
        role = Role.of(role)
        return sorted(c for c, rs in self.roles.items() if role in rs)

    def has(self, column: str, role) -> bool:
        return Role.of(role) in self.roles.get(column, set())

    # other forms

    def to_primitive(self) -> dict[str, list[str]]:
        return {r.value: self.columns_with(r) for r in Role}

    @classmethod
    def from_primitive(cls, columns_by_role: dict[str, list[str]]) -> RoleMap:
        out = cls()
        for role, columns in columns_by_role.items():
            for c in columns:
                out.add(c, role)
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_primitive())

    @classmethod
    def from_json(cls, text: str) -> RoleMap:
        return cls.from_primitive(json.loads(text))

    def by_variable(self, spark: SparkSession) -> DataFrame:
        """One row for each column: Variable, Role."""
        order = list(Role)
        rows = [(c, ", ".join(r.value for r in sorted(rs, key=order.index))) for c, rs in sorted(self.roles.items())]
        return spark.createDataFrame(rows, "Variable string, Role string")

    def by_role(self, spark: SparkSession) -> DataFrame:
        """One row for each role, in their fixed order: Role, Variable."""
        return spark.createDataFrame([(r.value, ", ".join(self.columns_with(r))) for r in Role], "Role string, Variable string")
