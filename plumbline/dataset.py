"""A DataFrame with a name, roles and an order of rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.roles import Role, RoleMap
from plumbline.types import family, is_geometry


@dataclass(frozen=True)
class Dataset:
    """Immutable; every column is a predictor unless roles are given."""

    df: DataFrame
    roles: RoleMap | None = None
    name: str | None = None
    #: Columns that order the rows; preview and sampling need it, since rows of a DataFrame have none.
    order_by: tuple[str, ...] = field(default=())

    def __post_init__(self):
        roles = self.roles
        if roles is not None and not isinstance(roles, RoleMap):
            roles = RoleMap.from_primitive(roles)
        object.__setattr__(self, "roles", RoleMap.uniform(self.df.columns) if roles is None else roles)

    @classmethod
    def of(cls, data, spark: SparkSession | None = None, **more) -> Dataset:
        """From a Spark, pandas or Arrow table, or from whatever has to_pandas; not-a-number becomes missing."""
        if isinstance(data, Dataset):
            return data
        if not isinstance(data, DataFrame):
            spark = spark or SparkSession.getActiveSession()
            if hasattr(data, "to_pandas") and not isinstance(data, pd.DataFrame):
                data = data.to_pandas()
            if not isinstance(data, pd.DataFrame):
                raise TypeError(f"no dataset can be made from {type(data).__name__}")
            data = spark.createDataFrame(data.astype(object).where(data.notna(), None) if data.isna().any().any() else data)
        return cls(no_nan(data), **more)

    def to_pandas(self) -> pd.DataFrame:
        return self.df.toPandas()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    @property
    def is_geodata(self) -> bool:
        return any(is_geometry(f) for f in self.df.schema)

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        return f"Dataset({self.name or 'unnamed'}: {', '.join(f'{n} {t}' for n, t in self.df.dtypes)})"

    def with_df(self, df: DataFrame) -> Dataset:
        """Other rows or columns; the roles of columns that stay are kept."""
        return replace(self, df=df, roles=self.roles.restricted(df.columns))

    def with_roles(self, roles: RoleMap) -> Dataset:
        return replace(self, roles=roles.copy())

    def named(self, name: str) -> Dataset:
        return replace(self, name=name)

    # choice of columns

    def select_types(self, include=None, exclude=None) -> Dataset:
        """Columns whose storage or semantic family is included and not excluded."""
        as_set = lambda x: {x} if isinstance(x, str) else set(x or ())
        include, exclude = as_set(include), as_set(exclude)
        if include & exclude:
            raise ValueError(f"included and excluded: {sorted(include & exclude)}")
        keep = [f.name for f in self.df.schema if (not include or family(f) & include) and not family(f) & exclude]
        return self.with_df(self.df.select(*keep))

    def select_roles(self, include=None, exclude=None) -> Dataset:
        """Columns with an included role (if any is named) and without an excluded one."""
        as_set = lambda x: {Role.of(r) for r in ([x] if isinstance(x, (str, Role)) else x or ())}
        include, exclude = as_set(include), as_set(exclude)
        if include & exclude:
            raise ValueError(f"included and excluded: {sorted(r.value for r in include & exclude)}")
        keep = [c for c in self.columns if (not include or self.roles.get(c) & include) and not self.roles.get(c) & exclude]
        return self.with_df(self.df.select(*keep))

    def predictors(self) -> Dataset:
        """Predictors that aren't shadow variables."""
        found = self.select_roles(include=Role.PREDICTOR)
        return found.with_df(found.df.select(*[c for c in found.columns if not c.startswith("shadow__")]))

    def without_geometry(self) -> Dataset:
        return self.with_df(self.df.drop(*[f.name for f in self.df.schema if is_geometry(f)]))

    def rename(self, names: dict[str, str]) -> Dataset:
        """All renames at once; a new name may not be another column's old name unless that is renamed too."""
        names = {a: b for a, b in names.items() if a != b}
        if missing := [a for a in names if a not in self.columns]:
            raise KeyError(missing[0])
        after = [names.get(c, c) for c in self.columns]
        if len(set(after)) < len(after):
            raise ValueError("two columns would have one name")
        df = self.df.select(*[F.col(f"`{c}`").alias(names.get(c, c), metadata=self.df.schema[c].metadata) for c in self.columns])
        return replace(self, df=df, roles=self.roles.renamed(names), order_by=tuple(names.get(c, c) for c in self.order_by))

    # comparison

    def equals(self, other: Dataset, check_name: bool = True, check_roles: bool = True, check_crs: bool = True) -> bool:
        """Same schema and rows (as multisets), and name, roles and reference systems if asked for."""
        if not isinstance(other, Dataset) or (check_name and self.name != other.name) or (check_roles and self.roles != other.roles):
            return False
        kinds = lambda d: [(f.name, f.dataType) for f in d.df.schema]
        if kinds(self) != kinds(other):
            return False
        crs = lambda d: [(f.metadata or {}).get("crs") for f in d.df.schema if is_geometry(f)]
        if check_crs and crs(self) != crs(other):
            return False
        return self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()


def no_nan(df: DataFrame) -> DataFrame:
    """Not-a-number as missing, in every floating column."""
    found = [f for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name, metadata=f.metadata) for f in found}) if found else df
