"""The container: an observation and a variable dimension with long layers between them.

obs(obs_id, ...) and var(var_id, ...) hold one column for each annotation; a layer(obs_id, var_id, value) holds non-zeros
only; pairs of observations or variables are edges(src, dst, weight); arrays(obs_id or var_id, rank, value) hold
"top so many" annotations. All are immutable DataFrames, so a copy shares everything.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN = "x"


@dataclass(frozen=True)
class Dataset:
    obs: DataFrame
    var: DataFrame
    layers: dict[str, DataFrame]
    obs_pairs: dict[str, DataFrame] = field(default_factory=dict)
    var_pairs: dict[str, DataFrame] = field(default_factory=dict)
    obs_arrays: dict[str, DataFrame] = field(default_factory=dict)
    var_arrays: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, object] = field(default_factory=dict)

    # scans of one annotation

    def scalar(self, name: str):
        if name not in self.meta:
            raise KeyError(f"no scalar {name!r}")
        return self.meta[name]

    def layer(self, name: str = MAIN) -> DataFrame:
        if name not in self.layers:
            raise KeyError(f"no layer {name!r}")
        return self.layers[name]

    def obs_values(self, name: str, total: bool = False) -> DataFrame:
        """obs_id and an annotation, or the row sums of a layer under the layer's name."""
        return self._values(self.obs, "obs_id", name, total)

    def var_values(self, name: str, total: bool = False) -> DataFrame:
        return self._values(self.var, "var_id", name, total)

    def _values(self, axis: DataFrame, key: str, name: str, total: bool) -> DataFrame:
        if not total:
            if name not in axis.columns:
                raise KeyError(f"no annotation {name!r}")
            return axis.select(key, name)
        sums = self.layer(name).groupBy(key).agg(F.sum("value").alias(name))
        return axis.select(key).join(sums, key, "left").select(key, F.coalesce(name, F.lit(0.0)).alias(name))

    def frame(self, name: str = MAIN) -> DataFrame:
        """A layer as one row an observation and one column a variable; for few variables only."""
        wide = self.layer(name).groupBy("obs_id").pivot("var_id").agg(F.sum("value"))
        return self.obs.select("obs_id").join(wide, "obs_id", "left").fillna(0.0)

    def names(self, axis: str, label: str | None = None) -> DataFrame:
        """axis o or v: the id and the name of each observation or variable, from the column `label` (default obs_name or
        var_name; where there is none, the id as text)."""
        table, key, default = (self.obs, "obs_id", "obs_name") if axis == "o" else (self.var, "var_id", "var_name")
        if label is not None and label not in table.columns:
            raise KeyError(f"no annotation {label!r}")
        column = label or (default if default in table.columns else key)
        return table.select(key, F.col(column).cast("string").alias("name"))

    def maybe_obs_values(self, name: str | None, total: bool = False) -> DataFrame | None:
        """obs_values(), or None if no name is given (a name that is given must exist)."""
        return None if name is None else self.obs_values(name, total)

    def maybe_var_values(self, name: str | None, total: bool = False) -> DataFrame | None:
        return None if name is None else self.var_values(name, total)

    def annotation(self, axis: str, name: str) -> DataFrame:
        """Long rows of axis oo or vv: (src, dst, weight), oa or va: (obs_id or var_id, rank, value)."""
        found = {"oo": self.obs_pairs, "vv": self.var_pairs, "oa": self.obs_arrays, "va": self.var_arrays}[axis]
        if name not in found:
            raise KeyError(f"no annotation {name!r} of {axis}")
        return found[name]

    def annotation_frame(self, axis: str, name: str) -> DataFrame:
        """The same with one row for each observation or variable of the axis and one column for each other end (pairs
        without an edge are 0) or rank (null where there are fewer); for few columns only."""
        rows = self.annotation(axis, name)
        table, key = (self.obs, "obs_id") if axis[0] == "o" else (self.var, "var_id")
        if axis[1] == "a":
            wide = rows.groupBy(key).pivot("rank").agg(F.first("value"))
            return table.select(key).join(wide, key, "left")
        wide = rows.withColumnRenamed("src", key).groupBy(key).pivot("dst").agg(F.sum("weight"))
        return table.select(key).join(wide, key, "left").fillna(0.0, [c for c in wide.columns if c != key])

    def has(self, axis: str, name: str) -> bool:
        """axis: m, o, v, vo, oo, vv, oa or va."""
        where = {
            "m": self.meta, "o": self.obs.columns, "v": self.var.columns, "vo": self.layers, "oo": self.obs_pairs,
            "vv": self.var_pairs, "oa": self.obs_arrays, "va": self.var_arrays,
        }
        return name in where[axis]

    # new annotations

    def with_scalar(self, name: str, value) -> Dataset:
        return replace(self, meta=self.meta | {name: value})

    def with_layer(self, name: str, layer: DataFrame) -> Dataset:
        return replace(self, layers=self.layers | {name: layer})

    def with_obs(self, values: DataFrame, default=None) -> Dataset:
        """Adds (or replaces) the columns of values(obs_id, ...); observations without a row get the default."""
        return replace(self, obs=_annotated(self.obs, values, "obs_id", default))

    def with_var(self, values: DataFrame, default=None) -> Dataset:
        return replace(self, var=_annotated(self.var, values, "var_id", default))

    def with_obs_pairs(self, name: str, edges: DataFrame) -> Dataset:
        return replace(self, obs_pairs=self.obs_pairs | {name: edges})

    def with_var_pairs(self, name: str, edges: DataFrame) -> Dataset:
        return replace(self, var_pairs=self.var_pairs | {name: edges})

    def with_obs_array(self, name: str, rows: DataFrame) -> Dataset:
        """rows(obs_id, rank, value)."""
        return replace(self, obs_arrays=self.obs_arrays | {name: rows.select("obs_id", "rank", "value")})

    def with_var_array(self, name: str, rows: DataFrame) -> Dataset:
        return replace(self, var_arrays=self.var_arrays | {name: rows.select("var_id", "rank", "value")})

    def named(self, name: str) -> Dataset:
        """A leading dot appends to the present name."""
        return self.with_scalar("name", str(self.meta.get("name", "")) + name if name.startswith(".") else name)

    # slices

    def keep(self, obs: DataFrame | None = None, var: DataFrame | None = None, track: str | None = None) -> Dataset:
        """The observations and variables in obs(obs_id) and var(var_id); track names a column for the original ids."""
        new_obs = self.obs if obs is None else self.obs.join(obs.select("obs_id").distinct(), "obs_id", "left_semi")
        new_var = self.var if var is None else self.var.join(var.select("var_id").distinct(), "var_id", "left_semi")
        if track:
            new_obs, new_var = new_obs.withColumn(track, F.col("obs_id")), new_var.withColumn(track, F.col("var_id"))

        def cut(layer: DataFrame) -> DataFrame:
            if obs is not None:
                layer = layer.join(new_obs.select("obs_id"), "obs_id", "left_semi")
            return layer if var is None else layer.join(new_var.select("var_id"), "var_id", "left_semi")

        def cut_edges(edges: DataFrame, ids: DataFrame, key: str) -> DataFrame:
            for end in ("src", "dst"):
                edges = edges.join(ids.select(F.col(key).alias(end)), end, "left_semi")
            return edges.select("src", "dst", "weight")

        return replace(
            self,
            obs=new_obs,
            var=new_var,
            layers={k: cut(x) for k, x in self.layers.items()},
            obs_pairs=self.obs_pairs if obs is None else {k: cut_edges(x, new_obs, "obs_id") for k, x in self.obs_pairs.items()},
            var_pairs=self.var_pairs if var is None else {k: cut_edges(x, new_var, "var_id") for k, x in self.var_pairs.items()},
            obs_arrays=self.obs_arrays if obs is None else {k: x.join(new_obs.select("obs_id"), "obs_id", "left_semi") for k, x in self.obs_arrays.items()},
            var_arrays=self.var_arrays if var is None else {k: x.join(new_var.select("var_id"), "var_id", "left_semi") for k, x in self.var_arrays.items()},
        )


def _annotated(axis: DataFrame, values: DataFrame, key: str, default) -> DataFrame:
    new = [c for c in values.columns if c != key]
    joined = axis.drop(*new).join(values, key, "left")
    return joined if default is None else joined.fillna(default, subset=new)
