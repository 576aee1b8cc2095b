"""Numerical kernels on each series of a table, in grouped pandas functions. Errors become rows, never failures."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.kernels import dynamics as D
from sedge.kernels import surrogates as G

def seed_of(seed: int, *parts: object) -> int:
    """The seed of joined parts: first four bytes of a SHA-256, little endian."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).digest()[:4], "little")


def embedding(x: np.ndarray) -> list[float]:
    """Delay, dimension and Theiler window of a series."""
    delay = min(10, D.first_minimum(D.mutual_information(x, min(30, len(x) // 4))))
    dims = D.embedding_dimension(D.false_neighbours(x, 5, delay, delay))
    return [delay, dims, max(delay * dims, 5)]


def descriptors(x: np.ndarray, params: Sequence[float] | None = None) -> dict[str, float]:
    """The descriptor vector in an embedding, by default the series' own."""
    delay, dims, theiler = (int(p) for p in (embedding(x) if params is None else params))
    h, c = D.entropy_complexity(D.ordinal_counts(x, 4))
    rec = D.recurrence(x, dims, delay, theiler)
    return {"entropy": h, "complexity": c, "asymmetry": D.reversal_asymmetry(x, delay), "error": D.prediction_error(x, dims, delay, theiler), "determinism": rec["det"], "laminarity": rec["lam"], "lyapunov": D.lyapunov(x, dims, delay, theiler, 12, (0, 6))[0], "dimension": D.correlation_dimension(x, dims, delay, theiler)}


def checked_series(values) -> np.ndarray:
    """A series without gaps, that varies; raises otherwise: what is left of a gap is not a series of equal steps."""
    x = np.array([np.nan if v is None else v for v in values], float)
    if not np.isfinite(x).all():
        raise ValueError(f"{int((~np.isfinite(x)).sum())} of {len(x)} values are missing")
    return G.checked(x)


def replicate_stream(seed: int, replicate: int) -> np.random.Generator:
    """The generator of one replicate (from 1), the same wherever it is drawn."""
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(replicate - 1,)))


def replicate_values(series: DataFrame, cell: Sequence[str], order: str, x: str, measure: Callable[..., dict[str, float]], replicates: int, seed: int, make, prepare: Callable[[np.ndarray], list[float]] | None = None) -> DataFrame:
    """(cell, replicate, descriptor, value, n, error): the series' own values as replicate 0, those of surrogates from 1.

    A series is one array, of bounded length; its copies are dealt over the
    cluster by cell and replicate, so that one series' surrogates are many tasks.
    prepare's numbers of the series itself go to measure as a second argument,
    for its surrogates too.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    tasks = 3 * series.sparkSession.sparkContext.defaultParallelism
    whole = series.groupBy(*cell).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, x))), lambda s: s[x]).alias("_x"))
    if prepare is not None:

        def prepared(batches):
            for pdf in batches:
                found = []
                for values in pdf["_x"]:
                    try:
                        found.append([float(p) for p in prepare(checked_series(values))])
                    except Exception:  # the same failure is the result of replicate 0
                        found.append(None)
                yield pdf.assign(_p=found)

        whole = whole.repartition(tasks, *cell).mapInPandas(prepared, ", ".join(f"{c} {kinds[c]}" for c in cell) + ", _x array<double>, _p array<double>")
    copies = whole.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).repartition(tasks, *cell, "replicate")
    names = [*cell, "replicate", "descriptor", "value", "n", "error"]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                key, r = [row[c] for c in cell], int(row["replicate"])
                try:
                    v = checked_series(row["_x"])
                    got = measure(v if r == 0 else make(v, replicate_stream(seed_of(seed, *key), r)), *(() if prepare is None else (row["_p"],)))
                    rows += [(*key, r, name, float(value), len(v), None) for name, value in got.items()]
                except Exception as e:  # a cell's failure is a result of that cell
                    rows.append((*key, r, "error", None, len(row["_x"]), f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"{c} {kinds[c]}" for c in cell) + ", replicate int, descriptor string, value double, n int, error string"
    return copies.mapInPandas(run, schema)


def suite(series: DataFrame, cell: Sequence[str], order: str, x: str, measure=descriptors, replicates: int = 39, seed: int = 1, make=G.amplitude_adjusted, side: str = "two_sided", prepare=None) -> DataFrame:
    """A row for each cell and descriptor: the observed value, the surrogates' mean and sample deviation, z, the inclusive p, and how many surrogates gave a value.

    A cell that fails has one row named 'error'; so has one with gaps. side:
    greater, less, absolute or two_sided.
    """
    values = replicate_values(series, cell, order, x, measure, replicates, seed, make, prepare)
    known = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    values = values.where("replicate = 0 or descriptor <> 'error'").withColumn("value", known)
    seen = F.max(F.when(F.col("replicate") == 0, F.col("value"))).over(Window.partitionBy(*cell, "descriptor"))
    null = F.when(F.col("replicate") > 0, F.col("value"))
    rows = values.withColumn("_seen", seen)
    n = F.count(null)
    up, down = (1 + F.count(F.when(null >= F.col("_seen"), 1))) / (n + 1), (1 + F.count(F.when(null <= F.col("_seen"), 1))) / (n + 1)
    p = {"greater": up, "less": down, "absolute": (1 + F.count(F.when(F.abs(null) >= F.abs("_seen"), 1))) / (n + 1), "two_sided": F.least(F.lit(1.0), 2 * F.least(up, down))}[side]
    observed = F.max("_seen")
    out = rows.groupBy(*cell, "descriptor").agg(
        observed.alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), F.when(observed.isNotNull(), p).alias("pvalue"),
        n.cast("int").alias("n_null"), F.max("n").alias("n"), F.max("error").alias("error"),
    )
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    return out.select(*cell, "descriptor", "observed", "null_mean", "null_sd", z.alias("z"), "pvalue", "n_null", "n", "error")


def surrogate_rows(x: np.ndarray, measure: Callable[[np.ndarray], dict[str, float]], replicates: int, seed: int, make=G.amplitude_adjusted, side: str = "two_sided") -> list[dict]:
    """suite() of one series in one task, where very many short series are the tasks."""
    seen = measure(G.checked(x))
    null = pd.DataFrame([measure(make(x, replicate_stream(seed, r))) for r in range(1, replicates + 1)])
    out = []
    for name, v in seen.items():
        d = null[name].to_numpy()
        d = d[np.isfinite(d)]
        sd = d.std(ddof=1) if len(d) > 1 else np.nan
        out.append({"descriptor": name, "observed": v, "z": (v - d.mean()) / sd if sd > 0 else None, "pvalue": G.p_value(v, d, side), "n_null": len(d), "n": len(x)})
    return out


def per_series(series: DataFrame, cell: Sequence[str], order: str, columns: Sequence[str], fn: Callable[..., dict[str, float]], outputs: Sequence[str]) -> DataFrame:
    """fn of a cell's ordered columns (as arrays) gives the outputs; nulls and an error where it fails, or where a column has gaps."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got, error = {}, None
        try:
            got = fn(*(checked_series(pdf[c]) for c in columns))
        except Exception as e:  # a cell's failure is a result of that cell
            error = f"{type(e).__name__}: {e}"[:200]
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in cell}, **{o: got.get(o) for o in outputs}, "error": error}])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cell), *(f"{o} double" for o in outputs), "error string"])
    return series.select(*cell, order, *columns).groupBy(*cell).applyInPandas(run, schema)
