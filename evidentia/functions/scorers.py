"""Pluggable scorers: a service that answers batches of pairs in place of a built-in score, with a fallback for each pair.

A service is any function from a list of (text, text) to a JSON object of scores by index ("0", "1", ...), as chat services
answer. Off by default; nothing here calls the network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evidentia.functions.similarity import token_set_ratio

CHUNK = 40
Service = Callable[[list[tuple[str, str]]], str]


def parse_scores(answer: str) -> dict[int, float]:
    """Scores by index of an answer that may be fenced or have words around its first JSON object, nested ones included; what is no number is left out."""
    raw, text = {}, answer or ""
    for at in (i for i, c in enumerate(text) if c == "{"):
        try:
            raw = json.JSONDecoder().raw_decode(text, at)[0]
            break
        except ValueError:
            continue
    out = {}
    for k, v in raw.items():
        if re.fullmatch(r"\d+", str(k)):
            try:
                out[int(k)] = min(1.0, max(0.0, float(v)))
            except (TypeError, ValueError):
                continue
    return out


def batch_scorer(service: Service, a: str = "content_a", b: str = "content_b", fallback: Callable[[str, str], float] = token_set_ratio, chunk: int = CHUNK) -> Callable[..., Column]:
    """A scorer for scoring.features(scorers=...): distinct pairs of a batch go to the service `chunk` at a time; ids are local to the chunk, and a pair without an answer, or a chunk that fails, takes the fallback."""

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = list(dict.fromkeys((p or "", q or "") for p, q in zip(x, y, strict=True)))
        got: dict[tuple[str, str], float] = {}
        for i in range(0, len(pairs), chunk):
            part = pairs[i : i + chunk]
            try:
                answers = parse_scores(service(part))
            except Exception:  # noqa: BLE001  whatever a service raises
                answers = {}
            got |= {p: answers[k] if k in answers else fallback(*p) for k, p in enumerate(part)}
        return pd.Series([got[p or "", q or ""] for p, q in zip(x, y, strict=True)], dtype="float64")

    return lambda pairs: F.pandas_udf(score, DoubleType())(F.col(a), F.col(b))
