"""The generator: every draw is a hash of (seed, case, purpose, key), so cases don't depend on how they are partitioned.

The draws are digits of an MD5, which any SQL engine can repeat. Cases are independent; the dimensions that they join are
constants of this package, so broadcasting them is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.synth import dims
from evidentia.synth.dims import BASE_TIME, NO_PLACE, NoiseConfig

MODALITIES = ("video", "audio", "text")


def draw(purpose: str, *keys: Column | str) -> Column:
    """A number in [0, 1) for the row's case (columns seed, case_no), purpose and keys."""
    text = F.concat_ws("|", F.col("seed").cast("string"), F.col("case_no").cast("string"), F.lit(purpose), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def choice(u: Column, pool: Column) -> Column:
    return F.element_at(pool, (F.floor(u * F.size(pool)) + 1).cast("int"))


def between(u: Column, lo: Column, hi: Column) -> Column:
    """A whole number from lo to hi, both included."""
    return (lo + F.floor(u * (hi - lo + 1))).cast("long")


def role_requirements(slots: DataFrame) -> DataFrame:
    """(domain, template, role, n): how many of each role a template needs."""
    return slots.where("role_index is not null").groupBy("domain", "template", "role").agg((F.max("role_index") + 1).cast("long").alias("n"))


def cases(spark: SparkSession, n: int, seed: int = 42, start: int = 1, domain: str | None = None, suspects: int | None = None, witnesses: int | None = None) -> DataFrame:
    """Domain, template, counts and report header of each case. Counts asked for or drawn are raised to what the template needs."""
    base = spark.range(start, start + n).select(F.lit(seed).alias("seed"), F.col("id").alias("case_no"))
    names = F.array(*map(F.lit, dims.WINDOWS))
    base = base.withColumn("domain", F.lit(domain) if domain else choice(draw("domain"), names))
    templates = dims.dim_template(spark)
    picked = base.join(F.broadcast(templates), "domain").where(F.col("template_no") == F.floor(draw("template") * F.col("n_templates")))
    need = role_requirements(dims.dim_slot(spark)).groupBy("domain", "template").pivot("role", ["suspect", "witness"]).agg(F.first("n"))
    out = picked.join(F.broadcast(need.withColumnsRenamed({"suspect": "need_s", "witness": "need_w"})), ["domain", "template"])
    asked_s = F.lit(suspects).cast("long") if suspects else between(draw("suspects"), F.lit(1), F.lit(3))
    asked_w = F.lit(witnesses).cast("long") if witnesses else between(draw("witnesses"), F.lit(1), F.lit(2))
    out = out.withColumn("n_suspects", F.greatest(asked_s, F.coalesce("need_s", F.lit(0)))).withColumn("n_witnesses", F.greatest(asked_w, F.coalesce("need_w", F.lit(0))))
    text = F.replace(F.replace(choice(draw("description"), F.col("descriptions")), F.lit("{s}"), F.col("n_suspects").cast("string")), F.lit("{w}"), F.col("n_witnesses").cast("string"))
    fir = F.struct(
        choice(draw("crime"), F.col("crime_types")).alias("crime_type"), choice(draw("place"), F.col("locations")).alias("location"),
        F.array(F.lit(0).cast("long"), between(draw("window"), F.col("window_min"), F.col("window_max"))).alias("time_window"), text.alias("description"),
        F.struct(F.col("n_suspects").alias("suspect"), F.col("n_witnesses").alias("witness")).alias("roles"),
    )
    case_id = F.format_string("CASE_%s_%03d", F.upper(F.substring(F.replace("domain", F.lit("_"), F.lit("")), 1, 3)), "case_no")
    return out.select("seed", "case_no", case_id.alias("case_id"), "domain", "template", fir.alias("fir"))


def entities(case: DataFrame) -> DataFrame:
    """Entities of each case with an alias for each modality they show up in; the likeliest modality where none is drawn.

    Aliases are the k-th of a permutation of their pool, so they are unique within a case without drawing again.
    """
    spark = case.sparkSession

    def people(role: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(f"fir.roles.{role}").cast("int") - 1), lambda i: F.struct(F.lit(role).alias("role"), i.alias("role_index")))

    who = F.concat(people("suspect"), people("witness"))
    rows = case.select("seed", "case_no", "case_id", F.posexplode(who).alias("entity_no", "e")).select("seed", "case_no", "case_id", "entity_no", "e.role", "e.role_index")
    m = rows.join(F.broadcast(dims.dim_weight(spark)), "role").withColumn("hit", draw("modality", "entity_no", "modality") < F.col("p"))
    w = Window.partitionBy("case_no", "entity_no")
    best = F.row_number().over(w.orderBy(F.col("p").desc(), F.col("modality").desc()))
    m = m.withColumn("any", F.max("hit").over(w)).withColumn("best", best).where("hit or (not any and best = 1)")
    # 24 letters without I and O; steps that are prime to each pool's size walk through all of it
    letters = F.array(*(F.lit(c) for c in "ABCDEFGHJKLMNPQRSTUVWXYZ"))
    at = lambda size, step: F.pmod(F.floor(draw("alias", "modality") * size) + F.col("entity_no") * step, F.lit(size)).cast("int")
    k = at(360, 77)
    alias = (
        F.when(F.col("modality") == "video", F.format_string("Person_%02d", at(99, 31) + 1))
        .when(F.col("modality") == "audio", F.concat(F.lit("Speaker_"), F.element_at(letters, at(24, 7) + 1)))
        .otherwise(F.format_string("%s_%d", F.element_at(F.array(*map(F.lit, ("email", "sms", "report", "log"))), F.pmod(k, F.lit(4)) + 1), 10 + (k / 4).cast("int")))
    )
    return m.select("seed", "case_no", "case_id", "entity_no", F.concat_ws("_", "role", F.col("role_index") + 1).alias("entity_id"), "role", "role_index", "modality", alias.alias("alias"), "conf_lo", "conf_hi")


def timeline(case: DataFrame) -> DataFrame:
    """Ground-truth events: slots in order, some optional ones left out, at offsets that never fall.

    An offset past the window is drawn again within the window's last fifth, but not before the event before it. That depends on
    the offset before, so the offsets are a fold over the case's slots (at most nine), in SQL.
    """
    spark = case.sparkSession
    slots = case.select("seed", "case_no", "case_id", "domain", "template", F.col("fir.time_window")[1].alias("window")).join(F.broadcast(dims.dim_slot(spark)), ["domain", "template"])
    slots = slots.where(F.col("required") | (draw("skip", "slot_ord") >= 0.30))
    row = F.struct("slot_ord", "slot_id", "role", "role_index", "action", between(draw("delta", "slot_ord"), F.col("min_delta"), F.col("max_delta")).alias("delta"), draw("clamp", "slot_ord").alias("u"))
    per = slots.groupBy("seed", "case_no", "case_id", "window").agg(F.array_sort(F.collect_list(row)).alias("s"))
    lead = between(draw("lead"), F.lit(10), F.lit(60))

    def step(acc: Column, x: Column) -> Column:
        prev = F.element_at(acc, -1)
        to, end = prev + x["delta"], F.col("window")
        lo = F.least(F.greatest(prev + 1, F.floor(end * 0.8)), end)
        return F.concat(acc, F.array(F.when(to > end, between(x["u"], lo, end)).otherwise(to)))

    folded = per.withColumn("o", F.slice(F.aggregate("s", F.array(lead), step), 2, 1000))
    ev = folded.select("seed", "case_no", "case_id", F.posexplode(F.arrays_zip("s", "o")).alias("n", "z"))
    when = F.date_format(F.to_timestamp(F.lit(BASE_TIME)) + F.make_dt_interval(secs=F.col("z.o")), "yyyy-MM-dd'T'HH:mm:ss")
    return ev.select("seed", "case_no", "case_id", (F.col("n") + 1).alias("event_no"), F.concat(F.lit("E"), F.col("n") + 1).alias("event_id"), "z.s.slot_id", F.concat_ws("_", "z.s.role", F.col("z.s.role_index") + 1).alias("entity_id"), "z.s.role", "z.s.action", when.alias("timestamp"), F.col("z.o").alias("time_offset"))


def _phrase(spark: SparkSession, kind: str, name: str) -> DataFrame:
    return F.broadcast(dims.dim_phrase(spark).where(F.col("kind") == kind).select("action", F.col("pool").alias(name)))


def clean_observations(case: DataFrame, ents: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each event and modality its entity shows up in, in order, before noise."""
    spark = case.sparkSession
    order = F.array_position(F.array(*map(F.lit, MODALITIES)), F.col("modality"))
    rows = events.join(ents.select("case_no", "entity_id", "modality", "alias", "conf_lo", "conf_hi"), ["case_no", "entity_id"]).join(case.select("case_no", "domain", F.col("fir.time_window")[1].alias("window")), "case_no")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("case_no").orderBy("event_no", order)))
    rows = rows.join(F.broadcast(dims.dim_source(spark)), "modality").withColumn("source", choice(draw("source", "n"), F.col("sources")))
    rows = rows.join(F.broadcast(dims.dim_location(spark)), ["domain", "modality", "source"], "left")
    pools = dims.dim_phrase(spark).where(F.col("kind").isin(*MODALITIES)).select(F.col("kind").alias("modality"), "action", "pool")
    rows = rows.join(F.broadcast(pools), ["modality", "action"], "left")
    told = F.coalesce(choice(draw("content", "n"), F.col("pool")), F.concat(F.initcap(F.replace("action", F.lit("_"), F.lit(" "))), F.lit(".")))
    jitter = between(draw("jitter", "n"), F.lit(0), F.lit(3))
    when = F.to_timestamp("timestamp") + F.make_dt_interval(secs=jitter)
    return rows.select(
        "seed", "case_no", "case_id", "window", "n", F.concat(F.lit("O"), "n").alias("obs_id"), F.col("event_id").alias("event_ref"), F.col("alias").alias("entity"), F.col("entity_id").alias("canonical_entity"), "role", "modality", "source",
        F.coalesce("location", F.lit(NO_PLACE)).alias("location"), told.alias("content"), when.alias("when"), (F.col("time_offset") + jitter).alias("time_offset"), (F.col("conf_lo") + draw("confidence", "n") * (F.col("conf_hi") - F.col("conf_lo"))).alias("confidence"), "action",
    )


def inferred_action(content: Column) -> Column:
    """The action of the first keyword, in order, that a content holds."""
    low = F.lower(content)
    return F.coalesce(*(F.when(low.contains(word), F.lit(action)) for word, action in dims.KEYWORD_ACTIONS), F.lit(dims.NO_ACTION))


def sampled(obs: DataFrame, cfg: NoiseConfig = NoiseConfig()) -> DataFrame:  # noqa: B008
    """Marks rows as missing (a fifth, rounded down) and, among the others, as contradictions (at least one), by ranks of draws."""
    w = Window.partitionBy("case_no")
    n = F.count("*").over(w)
    out = obs.withColumn("_n", n).withColumn("_r", F.row_number().over(w.orderBy(draw("missing", "n"), "n")))
    out = out.withColumn("missing", F.col("_r") <= F.floor(F.col("_n") * cfg.missing_modality_rate))
    rank = F.row_number().over(Window.partitionBy("case_no", "missing").orderBy(draw("contradict", "n"), "n"))
    most = F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.col("_n") * cfg.contradiction_rate, 0).cast("long"))) if cfg.contradiction_rate > 0 else F.lit(0)
    return out.withColumn("contradicted", ~F.col("missing") & (rank <= most)).drop("_n", "_r")


def noisy(obs: DataFrame, cfg: NoiseConfig = NoiseConfig()) -> DataFrame:  # noqa: B008
    """Missing rows gone; contradictions, shifted times and reworded contents applied in that order, with tags; the true entity hidden.

    Observations without an action column, or without an action, get the one their content tells of.
    """
    spark = obs.sparkSession
    told = inferred_action(F.col("content"))
    obs = obs.withColumn("action", F.coalesce("action", told) if "action" in obs.columns else told)
    rows = sampled(obs, cfg).where("not missing").join(_phrase(spark, "denial", "denials"), "action", "left")
    for kind in ("video_quality", "text_integrity", "qualifier"):
        rows = rows.crossJoin(F.broadcast(dims.dim_phrase(spark).where(F.col("kind") == kind).select(F.col("pool").alias(kind))))  # one constant row
    denial = choice(draw("denial", "n"), F.col("denials"))
    stub = F.when(F.col("modality") == "video", choice(draw("stub", "n"), F.col("video_quality"))).otherwise(choice(draw("stub", "n"), F.col("text_integrity")))
    said = F.when(F.col("modality") == "audio", denial).when(draw("deny", "n") < 0.60, F.coalesce(denial, stub)).otherwise(stub)
    rows = rows.withColumn("contradicted", F.col("contradicted") & said.isNotNull())
    cut = F.when(F.col("modality") == "video", 0.20 + draw("drop", "n") * 0.20).otherwise(0.15 + draw("drop", "n") * 0.15)
    lo = F.greatest(F.lit(cfg.temporal_noise_min_sec), F.floor(F.col("window") * 0.005))
    hi = F.least(F.lit(3600), F.greatest(F.lit(cfg.temporal_noise_max_sec), F.floor(F.col("window") * 0.03)))
    shift = F.when(draw("shift?", "n") < cfg.temporal_noise_rate, between(draw("shift", "n"), lo, hi) * F.when(draw("sign", "n") < 0.5, -1).otherwise(1))
    bank = dims.dim_phrase(spark).where("kind = 'variant'").select(F.col("action").alias("content"), F.col("pool").alias("variants"))
    rows = rows.join(F.broadcast(bank), "content", "left")
    qualified = F.when(F.col("modality") == "video", F.concat(F.rtrim("content", F.lit(".")), choice(draw("vary", "n"), F.col("qualifier")), F.lit(".")))
    reworded = F.coalesce(choice(draw("vary", "n"), F.col("variants")), qualified)
    vary = (draw("vary?", "n") < cfg.semantic_variation_rate) & ~F.col("contradicted") & (reworded != F.col("content"))
    vary = F.coalesce(vary, F.lit(False))
    tags = F.array_compact(F.array(F.when(F.col("contradicted"), "contradiction"), F.when(shift.isNotNull(), "temporal_noise"), F.when(vary, "semantic_variation")))
    moved = F.date_format(F.col("when") + F.make_dt_interval(secs=F.coalesce(shift, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        "case_no", "case_id", "n", "obs_id", "event_ref", "entity", "role", "modality", "source", "location", F.when(F.col("contradicted"), said).when(vary, reworded).otherwise(F.col("content")).alias("content"), moved.alias("timestamp"),
        F.greatest(F.lit(0), F.col("time_offset") + F.coalesce(shift, F.lit(0))).alias("time_offset"), F.round(F.when(F.col("contradicted"), F.greatest(F.lit(0.10), F.col("confidence") - cut)).otherwise(F.col("confidence")), 3).alias("confidence"), tags.alias("noise_tags"),
    )


KEPT = ("obs_id", "entity", "role", "modality", "source", "location", "content", "timestamp", "time_offset", "confidence")


def case_documents(spark: SparkSession, n: int, noise: NoiseConfig = NoiseConfig(), **options) -> DataFrame:  # noqa: B008
    """Whole case documents, one row each, observations by their noisy time."""
    case = cases(spark, n, **options)
    ents, events = entities(case), timeline(case)
    obs = noisy(clean_observations(case, ents, events), noise)
    fields = [*KEPT[:9], "confidence", "event_ref", "noise_tags"]
    listed = obs.groupBy("case_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "n", F.struct(*fields).alias("o")))), lambda x: x["o"]).alias("observations"))
    people = ents.groupBy("case_no", "entity_no", "entity_id", "role").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "alias")))).alias("aliases"))
    people = people.groupBy("case_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("entity_no", F.to_json("aliases").alias("j"), "entity_id", "role"))), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["role"].alias("role"), F.from_json(x["j"], "map<string,string>").alias("aliases"))).alias("entities"))
    happened = events.groupBy("case_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_no", F.struct("event_id", "entity_id", "role", "action", "timestamp", "time_offset").alias("e")))), lambda x: x["e"]).alias("events"))
    mapping = ents.groupBy("case_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "entity_id")))).alias("entity_mapping"))
    out = case.join(listed, "case_no", "left").join(people, "case_no").join(happened, "case_no").join(mapping, "case_no")
    return out.select("case_id", "domain", "template", "fir", F.coalesce("observations", F.array()).alias("observations"), F.struct("entities", "events", "entity_mapping").alias("ground_truth"))


def observations_only(docs: DataFrame) -> DataFrame:
    """Case documents without ground truth, noise tags and event references: what the resolver reads."""
    return docs.select("case_id", "domain", "template", "fir", F.transform("observations", lambda o: F.struct(*(o[c].alias(c) for c in KEPT))).alias("observations"))


def validated(docs: DataFrame) -> DataFrame:
    """Adds `errors`: what is missing or does not hold in a case document (an empty list if nothing)."""
    obs, truth = F.col("observations"), F.col("ground_truth")
    lacks = lambda c, what: F.when(c, F.lit(what))
    none = [lacks(F.col(c).isNull(), f"no {c}") for c in ("case_id", "domain", "template", "fir")]
    rows = [lacks(F.size(F.array_compact(obs[c])) < F.size(obs), f"an observation has no {c}") for c in ("obs_id", "entity", "role", "modality", "content", "timestamp", "confidence")]
    count = lambda r: F.size(F.filter(truth["entities"], lambda e: e["role"] == r))
    ids = F.transform(truth["entities"], lambda e: e["entity_id"])
    least = F.create_map(*(F.lit(x) for (d, t), slots in dims.SLOTS.items() for r in ("suspect", "witness") for x in (f"{d}|{t}|{r}", max((s[2] + 1 for s in slots if s[1] == r and s[2] is not None), default=0))))
    need = lambda r: F.coalesce(F.element_at(least, F.concat_ws("|", "domain", "template", F.lit(r))), F.lit(0))
    checks = [
        lacks(count("suspect") < need("suspect"), "fewer suspects than the template needs"),
        lacks(count("witness") < need("witness"), "fewer witnesses than the template needs"),
        lacks(F.size(truth["events"]) == 0, "no events"),
        lacks(F.exists(truth["events"], lambda e: ~F.array_contains(ids, e["entity_id"])), "an event names no entity"),
        lacks(count("suspect") != F.col("fir.roles.suspect"), "suspects differ from the report"),
        lacks(count("witness") != F.col("fir.roles.witness"), "witnesses differ from the report"),
        lacks(F.exists(obs, lambda o: F.array_contains(ids, o["entity"])), "a true entity shows"),
        lacks(F.size(truth["entity_mapping"]) == 0, "no mapping"),
    ]
    return docs.withColumn("errors", F.array_compact(F.array(*none, *rows, *checks)))


def checked(docs: DataFrame) -> DataFrame:
    """The documents; the query that reads them fails at the first one with something wrong."""
    errors = F.col("errors")
    fail = F.raise_error(F.concat(F.lit("case "), F.coalesce("case_id", F.lit("without id")), F.lit(": "), F.array_join(errors, ", ")))
    return validated(docs).withColumn("case_id", F.when(F.size(errors) > 0, fail.cast("string")).otherwise(F.col("case_id"))).drop("errors")
