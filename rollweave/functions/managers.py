"""Reward managers: whole records in, a score per record and the reward on its last token out."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollweave.functions.scoring import dispatch, overlong_penalty

MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def manager(name: str) -> Callable:
    """Registers a manager (records -> records with ``score`` and ``reward``); a name can be taken once."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in MANAGERS:
            raise ValueError(f"manager {name!r} is registered already")
        MANAGERS[name] = f
        return f

    return add


def score_records(df: DataFrame, name: str, **options: object) -> DataFrame:
    if name not in MANAGERS:
        raise ValueError(f"unknown manager {name!r}; known: {sorted(MANAGERS)}")
    return MANAGERS[name](df, **options)


@manager("naive")
def naive(df: DataFrame, response: str, truth: str, source: str, by: Mapping[str, str]) -> DataFrame:
    """Built-in scorers by data source, on the JVM where the scorer is; null where a source has none."""
    s = dispatch(F.col(source), F.col(response), F.col(truth), dict(by), strict=False)
    return df.withColumn("score", s).withColumn("reward", F.coalesce("score", F.lit(0.0)))


@manager("dapo")
def dapo(df: DataFrame, scorer: Column, length: str, most: int, buffer: int = 0, factor: float = 1.0) -> DataFrame:
    """A score column less the penalty for overlong responses; without a buffer there is none. A null length costs nothing."""
    penalty = F.coalesce(overlong_penalty(F.col(length), most, buffer, factor), F.lit(0.0)) if buffer else F.lit(0.0)
    return df.withColumn("score", scorer).withColumn("reward", F.col("score") + penalty)


def _over_batches(df: DataFrame, cols: Sequence[str], run: Callable[[pd.DataFrame], Sequence[float | None]]) -> DataFrame:
    def go(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = pd.Series(list(run(pdf[list(cols)])), index=pdf.index, dtype=float)
            yield pdf.assign(score=scores, reward=scores.fillna(0.0))

    ddl = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(go, f"{ddl}, score double, reward double")


@manager("batch")
def batch(df: DataFrame, cols: Sequence[str], scorer: Callable[[pd.DataFrame], Sequence[float | None]]) -> DataFrame:
    """One call of ``scorer`` per Arrow batch with the named columns; it gives a score, or null, for every row."""
    return _over_batches(df, cols, scorer)


@manager("prime")
def prime(df: DataFrame, cols: Sequence[str], scorer: Callable[..., float], seconds: float = 10.0) -> DataFrame:
    """``scorer`` record by record in the worker processes; an error or a record that takes longer than ``seconds`` scores 0."""

    def run(pdf: pd.DataFrame) -> list[float]:
        def late(*_: object) -> None:
            raise TimeoutError

        out = []
        before = signal.signal(signal.SIGALRM, late)
        try:
            for row in pdf.itertuples(index=False, name=None):
                try:
                    signal.setitimer(signal.ITIMER_REAL, seconds)
                    out.append(float(scorer(*row)))
                except Exception:
                    out.append(0.0)
                finally:
                    signal.setitimer(signal.ITIMER_REAL, 0)
        finally:
            signal.signal(signal.SIGALRM, before)
        return out

    return _over_batches(df, cols, run)
