"""Datasets by package and name: a registry of loaders."""

from __future__ import annotations

import contextlib
import importlib
import io
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.dataset import Dataset

_LOADERS: dict[str, tuple[Callable[[], list[str]], Callable[[str], object]]] = {}


def register(package: str, names: Callable[[], list[str]], load: Callable[[str], object]) -> None:
    """``names`` lists what ``load`` can bring, as anything a Dataset is made of."""
    _LOADERS[package] = (names, load)


def load(spark: SparkSession, key: str) -> Dataset:
    """A dataset by "package::name"; an unknown package is a ValueError."""
    package, _, name = key.partition("::")
    if package not in _LOADERS:
        raise ValueError(f"Unknown package: {package}")
    return Dataset.of(_LOADERS[package][1](name), spark, name=name)


def catalogue(spark: SparkSession) -> DataFrame:
    """package, dataset of all loaders whose package is installed."""
    rows = []
    for package, (names, _) in sorted(_LOADERS.items()):
        with contextlib.suppress(ImportError):
            rows += [(package, n) for n in sorted(names(), key=str.lower)]
    return spark.createDataFrame(rows, "package string, dataset string")


def captured(f: Callable, *args) -> str:
    """What a function prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        f(*args)
    return out.getvalue()


def numbered_names(listing: str) -> list[str]:
    """Names of a printed list whose lines end in a number."""
    return [m[1].strip() for line in listing.splitlines() if (m := re.match(r"(.*\S)\s+\d+\s*$", line))]


def _module(name: str):
    return importlib.import_module(name)


def _statsmodels(name: str):
    """By package of R datasets, then by a module's own loaders, then as an attribute."""
    api, last = _module("statsmodels.api"), None
    attempts = [
        lambda: api.datasets.get_rdataset(name).data,
        *[lambda f=f: _frame(getattr(getattr(api.datasets, name), f)()) for f in ("load_pandas", "load", "data")],
        lambda: _frame(getattr(api.datasets, name)),
    ]
    for attempt in attempts:
        try:
            return attempt()
        except Exception as error:
            last = error
    raise ValueError(f"no dataset {name!r}: {last}")


def _frame(found):
    data = getattr(found, "data", found)
    if not hasattr(data, "columns"):
        raise ValueError("not a table")
    return data


def _sklearn_names() -> list[str]:
    return sorted(n.removeprefix("load_") for n in dir(_module("sklearn.datasets")) if n.startswith("load_"))


register("seaborn", lambda: _module("seaborn").get_dataset_names(), lambda n: _module("seaborn").load_dataset(n))
register("xarray", lambda: ["air_temperature", "rasm", "ersstv5"], lambda n: _module("xarray").tutorial.load_dataset(n).to_dataframe().reset_index())
register("sklearn", _sklearn_names, lambda n: getattr(_module("sklearn.datasets"), f"load_{n}")(as_frame=True).frame)
register("vega_datasets", lambda: _module("vega_datasets").data.list_datasets(), lambda n: getattr(_module("vega_datasets").data, n.replace("-", "_"))())
register("statsmodels", lambda: [n for n in dir(_module("statsmodels.api").datasets) if not n.startswith("_")], _statsmodels)
register("uci", lambda: numbered_names(captured(_module("ucimlrepo").list_available_datasets)), lambda n: _module("ucimlrepo").fetch_ucirepo(name=n).data.original)
