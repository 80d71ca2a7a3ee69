"""Optional rewriting of generated texts by a service; any failure leaves the case as it is. Nothing here calls the network."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrich(observations: DataFrame, service: Callable[[str], str]) -> DataFrame:
    """Rewrites content, source and location of observation rows (case_id, obs_id, content, source, location, ...) case by case.

    The service takes {"observations": [{obs_id, content, source, location}]} as JSON and answers in the same shape; empty or
    missing values keep what was there. A case's observations are few (nine slots, three modalities at most).
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ask = json.dumps({"observations": pdf[["obs_id", "content", "source", "location"]].to_dict("records")}, ensure_ascii=False)
        try:
            said = {r["obs_id"]: r for r in json.loads(service(ask).strip().removeprefix("```json").removesuffix("```"))["observations"]}
        except Exception:  # noqa: BLE001  whatever a service raises
            return pdf
        for c in ("content", "source", "location"):
            pdf[c] = [(said.get(i, {}).get(c) or "").strip() or old for i, old in zip(pdf["obs_id"], pdf[c], strict=True)]
        return pdf

    return observations.groupBy("case_id").applyInPandas(run, observations.schema)


def enriched_batches(docs: Iterator[pd.DataFrame], service: Callable[[str], str]) -> Iterator[pd.DataFrame]:
    """The same for a mapInPandas over report texts: rewrites `description`, keeping it where the service fails or is silent."""
    for pdf in docs:
        new = []
        for text in pdf["description"]:
            try:
                new.append(service(text).strip() or text)
            except Exception:  # noqa: BLE001  whatever a service raises
                new.append(text)
        yield pdf.assign(description=new)


ANSWER = "struct<fir:struct<description:string,location:string>,observations:array<struct<obs_id:string,content:string,source:string,location:string>>>"


def enrich_cases(docs: DataFrame, service: Callable[[str], str]) -> DataFrame:
    """Case documents with report and observation texts rewritten, one call of the service a case; `fir.enriched` says whether it answered.

    The service takes {"fir": {description, location}, "observations": [{obs_id, content, source, location}]} as JSON and answers in the
    same shape, fenced or not. Empty or missing values keep what was there; a call that fails, or an answer that is no JSON, keeps the case.
    Ids, roles, times, numbers and the truth are never touched.
    """

    def ask(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                said = service(text).strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
                return said if isinstance(json.loads(said), dict) else None
            except Exception:  # noqa: BLE001  whatever a service raises
                return None

        return texts.map(one)

    seen = F.transform("observations", lambda o: F.struct(*(o[c].alias(c) for c in ("obs_id", "content", "source", "location"))))
    question = F.to_json(F.struct(F.struct("fir.description", "fir.location").alias("fir"), seen.alias("observations")))
    rows = docs.withColumn("_a", F.from_json(F.pandas_udf(ask, "string")(question), ANSWER))
    said = lambda new, old: F.coalesce(F.when(F.trim(new) != "", F.trim(new)), old)

    def rewritten(o: Column) -> Column:
        new = F.try_element_at(F.filter("_a.observations", lambda a: a["obs_id"] == o["obs_id"]), F.lit(1))
        for c in ("content", "source", "location"):
            o = o.withField(c, said(new[c], o[c]))
        return o

    fir = F.col("fir").withField("enriched", F.col("_a").isNotNull())
    for c in ("description", "location"):
        fir = fir.withField(c, said(F.col(f"_a.fir.{c}"), F.col(f"fir.{c}")))
    listed = F.transform("observations", rewritten)
    return rows.withColumn("fir", fir).withColumn("observations", listed).select(*docs.columns)
