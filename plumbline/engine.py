"""Tables by layer: models register as views, marts can be read, queried and published."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("staging", "intermediate", "marts", "audit")
#: Layers that only the library's own models read.
INNER = ("staging", "intermediate")


class LayerWarning(UserWarning):
    """A query reads a model that isn't a mart."""


class Engine:
    """Models as temporary views named ``layer_model``; only marts answer to ``mart`` and plain names in ``query``."""

    def __init__(self, spark: SparkSession, strict: bool = False):
        """Where ``strict``, a query that reaches an inner layer is refused; else it is warned of."""
        self.spark, self.strict = spark, strict
        self._models: dict[str, dict[str, DataFrame]] = {layer: {} for layer in LAYERS}

    def register(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        if layer not in self._models:
            raise KeyError(f"no layer {layer!r}; there are {', '.join(LAYERS)}")
        self._models[layer][name] = df
        df.createOrReplaceTempView(f"{layer}_{name}")
        if layer == "marts":
            df.createOrReplaceTempView(name)
        return df

    def mart_names(self) -> list[str]:
        return sorted(self._models["marts"])

    def mart(self, name: str, columns: list[str] | None = None) -> DataFrame:
        found = self._models["marts"]
        if name not in found:
            raise KeyError(f"no mart {name!r}; there are {', '.join(sorted(found)) or 'none yet'}")
        if missing := [c for c in columns or [] if c not in found[name].columns]:
            raise KeyError(f"mart {name!r} has no column {', '.join(missing)}; it has {', '.join(found[name].columns)}")
        return found[name].select(*columns) if columns else found[name]

    def inner_models(self, df: DataFrame) -> list[str]:
        """The models of inner layers that a plan reads, through whatever views and subqueries; what a mart is made of is the mart's affair."""
        names = {f"{layer}_{name}" for layer in INNER for name in self._models[layer]}
        marts = {*self._models["marts"], *(f"marts_{name}" for name in self._models["marts"])}
        found, waiting = set(), [df._jdf.queryExecution().analyzed()]
        while waiting:
            plan = waiting.pop()
            if plan.nodeName() == "View":
                name = plan.desc().identifier().table()
                if name in names:
                    found.add(name)
                if name in names or name in marts:
                    continue
            waiting += [*_each(plan.children()), *_each(plan.subqueries()), *([d for d in _each(plan.cteDefs())] if plan.nodeName() == "WithCTE" else [])]
        return sorted(found)

    def query(self, sql: str) -> DataFrame:
        """SQL over marts. The rule is checked on the analysed plan, so views and subqueries don't hide a model."""
        df = self.spark.sql(sql)
        if inner := self.inner_models(df):
            told = f"the query reads {', '.join(inner)}; only marts are meant to be queried"
            if self.strict:
                raise PermissionError(told)
            warnings.warn(told, LayerWarning, stacklevel=2)
        return df

    def publish(self, name: str, df: DataFrame, path: str) -> int:
        """Write a mart and register it; its number of rows is counted while writing."""
        from pyspark.sql import Observation

        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        self.register("marts", name, self.spark.read.schema(df.schema).parquet(path))
        return rows.get["n"]


def _each(seq: Any) -> list[Any]:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]
