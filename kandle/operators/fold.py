"""The fold hook (F03): the one place where rows of a series are stepped through in order.

Everything else in this package is joins, windows and aggregates; a few recurrences are neither. They run
here, on bounded chunks of a series, as Arrow-batched grouped maps:

* ``fold_chunks``: every chunk at once, each on its own (or from a state that its rows bring along);
* ``fold_carried``: the chunks of a series one after the other, all series side by side: wave c steps
  through chunk c of every series that has one and hands a state row to wave c + 1. A task holds one chunk, whatever
  the length of a series; waves are written out, so a lost executor costs one wave's tasks.

Where the state after a chunk can be written down as a function of the state before it, chunks run at once and
the functions are composed (supertrend, ``kandle.operators.indicators``), which needs no waves.
"""
from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from kandle.sources.scratch import materialize

Step = Callable[[pd.DataFrame, "dict | None"], "tuple[pd.DataFrame, dict]"]


def fold_chunks(rows: DataFrame, by: list[str], order: str, step: Callable[[pd.DataFrame], pd.DataFrame], out: T.StructType | str) -> DataFrame:
    """``step`` on every group of ``by``, its rows in the order of ``order``. Groups must be bounded."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(order, kind="stable", ignore_index=True))

    return rows.groupBy(*by).applyInPandas(run, out)


def _fields(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def fold_carried(rows: DataFrame, keys: list[str], chunk: str, order: str, step: Step, out: T.StructType | str, state: T.StructType | str,
                 start: DataFrame | None = None, name: str = "fold") -> tuple[DataFrame, DataFrame]:
    """``step(rows of a chunk, state) -> (rows out, state)`` along every series (``keys``).

    ``rows`` have an integer column ``chunk`` that ascends along a series; a chunk is what one task holds. ``state`` is None
    for a series' first chunk, unless ``start`` (keys + state fields) has its row. Returns (keys + ``out``, keys + ``state`` after
    the last chunk). Series without rows keep their start state. Null keys are a series like any other."""
    out, state = _fields(out), _fields(state)
    key_fields = [next(f for f in rows.schema.fields if f.name == k) for k in keys]
    key_fields = [T.StructField(f.name, f.dataType) for f in key_fields]
    nullable = lambda s: [T.StructField(f.name, f.dataType) for f in s.fields]
    flat = T.StructType([*key_fields, T.StructField("_is_state", T.BooleanType()), *nullable(out),
                         *[T.StructField(f"_s_{f.name}", f.dataType) for f in state.fields]])
    held = materialize(rows, f"{name}-rows")
    chunks = [r[0] for r in held.select(chunk).distinct().orderBy(chunk).collect()]  # a number for each wave
    if start is None:
        start = rows.sparkSession.createDataFrame([], T.StructType([*key_fields, *nullable(state)]))
    names = [f.name for f in out.fields]

    def wave(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        before = None if right.empty else {f.name: right[f.name].iloc[0] for f in state.fields}
        if left.empty:
            return pd.DataFrame(columns=[f.name for f in flat.fields])
        got, after = step(left.sort_values(order, kind="stable", ignore_index=True), before)
        got = got.reindex(columns=names).assign(_is_state=False)
        last = pd.DataFrame([{"_is_state": True, **{f"_s_{k}": v for k, v in after.items()}}])
        whole = pd.concat([got, last], ignore_index=True) if len(got) else last
        for k, v in zip(keys, key):
            whole[k] = v
        whole = whole.reindex(columns=[f.name for f in flat.fields])
        for f in flat.fields:
            if isinstance(f.dataType, T.ArrayType):  # a missing list is NULL, not NaN
                whole[f.name] = [None if isinstance(v, float) else v for v in whole[f.name]]
        return whole

    states, outs = start, []
    for i, at in enumerate(chunks):
        here = held.where(F.col(chunk) == at)
        done = here.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(wave, flat)
        done = materialize(done, f"{name}-{i}")
        outs.append(done.where("NOT _is_state").select(*keys, *names))
        new = done.where("_is_state").select(*keys, *[F.col(f"_s_{f.name}").alias(f.name) for f in state.fields])
        same = [states[k].eqNullSafe(new[k]) for k in keys]
        states = states.join(new.select(*keys), same, "left_anti").unionByName(new)
    if not outs:
        outs = [rows.sparkSession.createDataFrame([], T.StructType([*key_fields, *nullable(out)]))]
    whole = outs[0]
    for more in outs[1:]:
        whole = whole.unionByName(more)
    return whole, states
