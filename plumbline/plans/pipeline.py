"""Pipelines: an ordered list of stages from dataset to dataset.

Stages are lazy, so a pipeline is one plan.  A stage that observes only, or is
switched off, passes its input on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from plumbline.dataset import Dataset
from plumbline.operators import convert as C
from plumbline.operators import placeholders as H
from plumbline.roles import RoleMap

#: Copies of one kind of stage in a pipeline at most.
MOST_COPIES = 10


def _import(data, *, path: str, **options):
    from pyspark.sql import SparkSession

    from plumbline.sources.readers import read

    return read(SparkSession.getActiveSession(), path, **options)


def _modify(data: Dataset, *, changes: list[dict], **options) -> Dataset:
    return C.modify(data, [C.Change(**c) for c in changes], **options)


def _resolve(data: Dataset, *, sentinels: list[str], **options) -> Dataset:
    return data.with_df(H.resolve(data.df, sentinels, **options))


def _roles(data: Dataset, *, roles: dict[str, list[str]]) -> Dataset:
    return data.with_roles(RoleMap.from_primitive(roles))


def _filter(data: Dataset, *, condition: str) -> Dataset:
    return data.with_df(data.df.where(condition))


def _select(data: Dataset, *, include=None, exclude=None, by: str = "types") -> Dataset:
    return data.select_types(include, exclude) if by == "types" else data.select_roles(include, exclude)


def _observe(data: Dataset, **options) -> Dataset:
    return data


#: kind -> function of a dataset and settings.
STAGES = {"import": _import, "modify": _modify, "placeholders": _resolve, "roles": _roles, "filter": _filter, "select": _select, "preview": _observe, "dissimilarity": _observe, "summary": _observe}
_CODE = {
    "import": "data = read(spark, {path!r})", "modify": "data = modify(data, [Change(**c) for c in {changes!r}])", "placeholders": "data = data.with_df(resolve(data.df, {sentinels!r}))",
    "roles": "data = data.with_roles(RoleMap.from_primitive({roles!r}))", "filter": "data = data.with_df(data.df.where({condition!r}))",
}


def register(kind: str, function, code: str | None = None) -> None:
    """A stage of one's own."""
    STAGES[kind] = function
    if code:
        _CODE[kind] = code


@dataclass(frozen=True)
class Stage:
    kind: str
    settings: dict[str, Any] = field(default_factory=dict)
    name: str = ""
    enabled: bool = True

    def transform(self, data: Dataset | None) -> Dataset | None:
        if not self.enabled:
            return data
        if data is None and self.kind != "import":
            return None  # nothing to pass on yet
        return STAGES[self.kind](data, **self.settings)

    def code(self) -> str:
        """The stage as a statement."""
        if self.kind not in STAGES:
            raise ValueError(f"unknown stage: {self.kind}")
        if not self.enabled:
            return f"# {self.name}: off"
        return _CODE[self.kind].format(**self.settings) if self.kind in _CODE else f"# {self.name}: {self.kind} {self.settings}"


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...] = ()

    def insert(self, kind: str, at: int | None = None, name: str | None = None, **settings) -> Pipeline:
        """With another stage; its name is unique."""
        if kind not in STAGES:
            raise ValueError(f"unknown stage: {kind}")
        copies = sum(s.kind == kind for s in self.stages)
        if copies >= MOST_COPIES:
            raise ValueError(f"more than {MOST_COPIES} stages of kind {kind}")
        taken = {s.name for s in self.stages}
        name = name or next(n for n in (kind, *(f"{kind}_{i}" for i in range(2, MOST_COPIES + 2))) if n not in taken)
        if name in taken:
            raise ValueError(f"a stage is named {name} already")
        stages = list(self.stages)
        stages.insert(len(stages) if at is None else at, Stage(kind, settings, name))
        return Pipeline(tuple(stages))

    def _at(self, name: str) -> int:
        for i, s in enumerate(self.stages):
            if s.name == name:
                return i
        raise KeyError(name)

    def remove(self, name: str) -> Pipeline:
        at = self._at(name)
        return Pipeline(self.stages[:at] + self.stages[at + 1 :])

    def move(self, name: str, to: int) -> Pipeline:
        stages = list(self.stages)
        stages.insert(to, stages.pop(self._at(name)))
        return Pipeline(tuple(stages))

    def change(self, name: str, **settings) -> Pipeline:
        at = self._at(name)
        stage = replace(self.stages[at], settings=self.stages[at].settings | settings)
        return Pipeline((*self.stages[:at], stage, *self.stages[at + 1 :]))

    def switch(self, name: str | None, enabled: bool) -> Pipeline:
        """One stage, or all, on or off."""
        if name is not None:
            self._at(name)
        return Pipeline(tuple(replace(s, enabled=enabled) if name in (None, s.name) else s for s in self.stages))

    def run(self, data: Dataset | None = None) -> Dataset | None:
        for stage in self.stages:
            data = stage.transform(data)
        return data

    def until(self, name: str, data: Dataset | None = None) -> Dataset | None:
        """What a stage gives."""
        return Pipeline(self.stages[: self._at(name) + 1]).run(data)

    def code(self) -> str:
        return "\n".join(s.code() for s in self.stages)

    def to_json(self) -> str:
        return json.dumps([{"kind": s.kind, "name": s.name, "enabled": s.enabled, "settings": s.settings} for s in self.stages])

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        """From a specification, which is checked."""
        found = json.loads(text)
        if not isinstance(found, list):
            raise ValueError("a pipeline is a list of stages")
        out = cls()
        for entry in found:
            if not isinstance(entry, dict) or not isinstance(entry.get("kind"), str) or not isinstance(entry.get("settings", {}), dict) or set(entry) - {"kind", "name", "enabled", "settings"}:
                raise ValueError(f"not a stage: {entry!r}")
            if not isinstance(entry.get("enabled", True), bool):
                raise ValueError("enabled is true or false")
            out = out.insert(entry["kind"], name=entry.get("name"), **entry.get("settings", {}))
            if not entry.get("enabled", True):
                out = out.switch(out.stages[-1].name, False)
        return out
