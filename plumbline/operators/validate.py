"""Whether roles fit the data they are given for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.dataset import Dataset
from plumbline.operators.profile import is_key
from plumbline.roles import Role, RoleMap
from plumbline.types import is_geometry


def validate(data: Dataset, roles: RoleMap | None = None, separator: str = "|", low_cardinality: int = 8, check_geometry: bool = False) -> list[str]:
    """Messages about what doesn't fit; none if all does.  Missing counts, distinct counts and minima come
    from one aggregation, the key from another."""
    roles = data.roles if roles is None else roles
    df = data.df
    if not roles.roles:
        return [""]
    out = []
    have, named = set(df.columns), set(roles.roles)
    if have - named:
        out.append("Columns present in data but missing from role map: " + ", ".join(sorted(have - named)))
    if named - have:
        out.append("Columns present in role map but missing from data: " + ", ".join(sorted(named - have)))
    if not df.columns:
        return [*out, "Data has no observations", "Data has no variables"]
    with_role = {r: roles.columns_with(r) for r in Role}
    needed = {r: with_role[r] for r in (Role.TARGET, Role.PARTITION, Role.SEQUENCE, Role.WEIGHTING, Role.TREATMENT, Role.SENSITIVE, Role.STRATIFIER)}
    keys = with_role[Role.IDENTIFIER] + with_role[Role.SEQUENCE]
    single = {r: cs[0] for r, cs in needed.items() if len(cs) == 1}
    unknown = [c for c in [*single.values(), *keys] if c not in have]
    aggs = [F.count(F.lit(1)).alias("rows")]
    if not unknown:
        for r, name in single.items():
            c = F.col(f"`{name}`")
            aggs.append(F.count_if(c.isNull()).alias(f"{r.value}_missing"))
            if r in (Role.PARTITION, Role.TREATMENT, Role.SENSITIVE, Role.STRATIFIER):
                aggs.append((F.count_distinct(c) + F.max(c.isNull().cast("int"))).alias(f"{r.value}_values"))
            if r is Role.WEIGHTING and isinstance(df.schema[name].dataType, T.NumericType):
                aggs.append(F.count_if(c < 0).alias("negative"))
    row = df.agg(*aggs).first()
    if not row["rows"]:
        out.append("Data has no observations")
    if unknown:
        return [*out, "The role assignments and data are incompatible"]

    def one(role: Role, extra) -> None:
        title = role.value.capitalize()
        if len(needed[role]) > 1:
            out.append(f"{title} role must be singular")
        elif role in single:
            out.extend(extra(df.schema[single[role]].dataType))
            if row[f"{role.value}_missing"]:
                out.append(f"{title} role has missing values")

    plain = (T.NumericType, T.StringType, T.BooleanType)
    one(Role.TARGET, lambda k: [] if isinstance(k, plain) else ["Target role must be numeric or categorical"])
    if not with_role[Role.PREDICTOR]:
        out.append("Predictor role must be assigned to a variable")
    if keys and not is_key(df, keys, separator).first()["is_unique"]:
        out.append("Identifier/Sequence combination must be unique")
    one(Role.PARTITION, lambda k: [] if row["partition_values"] == 2 else ["Partition role must have cardinality 2"])
    one(Role.SEQUENCE, lambda k: [])
    one(Role.WEIGHTING, lambda k: ["Weighting role must be numeric"] if not isinstance(k, T.NumericType) else ["Weighting role must be non-negative"] if row["negative"] else [])
    for role in (Role.TREATMENT, Role.SENSITIVE, Role.STRATIFIER):
        one(role, lambda k, r=role: [] if (row[f"{r.value}_values"] or 0) <= low_cardinality else [f"{r.value.capitalize()} role must have low cardinality"])
    if check_geometry:
        places = with_role[Role.GEOMETRY]
        if len(places) > 1:
            out.append("Geometry role must be singular")
        elif places and not is_geometry(df.schema[places[0]]):
            out.append("Geometry role must be a geometry")
    return out


def validation(data: Dataset, roles: RoleMap | None = None, **options) -> DataFrame:
    """ord, message."""
    return data.df.sparkSession.createDataFrame(list(enumerate(validate(data, roles, **options))), "ord int, message string")
