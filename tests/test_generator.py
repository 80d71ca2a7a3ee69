import pytest
from pyspark.sql import functions as F

from evidentia import cli
from evidentia.operators.entities import Resolution
from evidentia.operators.intake import flatten
from evidentia.schema import CASE
from evidentia.synth import dims, enrich, generate


@pytest.fixture(scope="module")
def docs(spark):
    return generate.case_documents(spark, 80).cache()


def test_cases_are_whole(docs):
    rows = generate.validated(docs).collect()
    assert len(rows) == 80 and all(r.errors == [] for r in rows)
    assert {r.domain for r in rows} == set(dims.WINDOWS)
    need = {}
    for (d, t), slots in dims.SLOTS.items():
        for s in slots:
            need[t, s[1]] = max(need.get((t, s[1]), 0), s[2] + 1)
    for r in rows:
        lo, hi = dims.WINDOWS[r.domain]
        assert lo <= r.fir.time_window[1] <= hi
        assert r.fir.roles.suspect >= need[r.template, "suspect"] and r.fir.roles.witness >= need[r.template, "witness"]
        off = [e.time_offset for e in r.ground_truth.events]
        assert off == sorted(off) and off[-1] <= r.fir.time_window[1]
        actions = [s[3] for s in dims.SLOTS[r.domain, r.template] if s[4]]
        assert not set(actions) - {e.action for e in r.ground_truth.events}
        times = [o.timestamp for o in r.observations]
        assert times == sorted(times)
        mapping, entities = r.ground_truth.entity_mapping, {e.entity_id: e for e in r.ground_truth.entities}
        assert all(o.entity in mapping for o in r.observations)
        assert all(mapping[a] == e.entity_id for e in entities.values() for a in e.aliases.values())
        assert len(mapping) == sum(len(e.aliases) for e in entities.values()) and all(e.aliases for e in entities.values())


def test_noise(spark):
    case = generate.cases(spark, 80)
    clean = generate.clean_observations(case, generate.entities(case), generate.timeline(case)).cache()
    marked = generate.sampled(clean).groupBy("case_no").agg(F.count("*").alias("n"), F.count_if("missing").alias("m"), F.count_if("contradicted").alias("c")).collect()
    for r in marked:
        assert r.m == int(r.n * 0.2) and r.c == min(r.n, max(1, round(r.n * 0.075)), r.n - r.m)
    rows = generate.noisy(clean).join(clean.select("case_no", "n", "window", F.col("content").alias("was"), F.col("confidence").alias("had"), F.date_format("when", "yyyy-MM-dd'T'HH:mm:ss").alias("at")), ["case_no", "n"]).collect()
    shares = {t: sum(t in r.noise_tags for r in rows) / len(rows) for t in ("temporal_noise", "semantic_variation", "contradiction")}
    assert 0.5 < shares["temporal_noise"] < 0.7 and shares["contradiction"] > 0.05
    for r in rows:
        assert ("temporal_noise" in r.noise_tags) == (r.timestamp != r["at"])
        assert not {"contradiction", "semantic_variation"} <= set(r.noise_tags)
        assert (r.content != r.was) == bool({"contradiction", "semantic_variation"} & set(r.noise_tags))
        assert 0.1 <= r.confidence <= 0.95 and ("contradiction" in r.noise_tags or r.confidence == pytest.approx(r.had, abs=6e-4))


def test_same_seed_same_cases(spark, docs):
    again = generate.case_documents(spark, 80).repartition(7)
    text = F.to_json(F.struct("*"))
    assert sorted(r[0] for r in docs.select(text).collect()) == sorted(r[0] for r in again.select(text).collect())
    other = generate.case_documents(spark, 5, seed=1, domain="Communication", suspects=3, witnesses=2).collect()
    assert all(r.domain == "Communication" and r.fir.roles.suspect == 3 and r.fir.roles.witness == 2 for r in other)


def test_observations_only_and_resolution_quality(spark, docs):
    only = generate.observations_only(docs)
    assert "ground_truth" not in only.columns and set(only.schema["observations"].dataType.elementType.names) == set(generate.KEPT)
    raw = flatten(only.select("case_id", F.from_json(F.to_json(F.struct("case_id", "observations")), CASE)["observations"].alias("observations")))
    r = Resolution(raw)
    truth = docs.select("case_id", F.explode("ground_truth.entity_mapping").alias("entity", "truth"))
    m = r.members.join(r.obs.select("case_id", "obs_id", "entity"), ["case_id", "obs_id"]).join(truth, ["case_id", "entity"]).select("case_id", "obs_id", "cluster_id", "truth").collect()
    hit = same = linked = 0
    for i, a in enumerate(m):
        for b in m[:i]:
            if a.case_id == b.case_id:
                t, c = a.truth == b.truth, a.cluster_id == b.cluster_id
                hit, same, linked = hit + (t and c), same + t, linked + c
    assert hit / same > 0.5 and hit / linked > 0.3


def test_enrichment_keeps_rows_when_the_service_fails(spark, docs):
    rows = docs.limit(2).select("case_id", F.explode("observations").alias("o")).select("case_id", "o.obs_id", "o.content", "o.source", "o.location")
    kept = enrich.enrich(rows, lambda ask: 1 / 0)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
    one = rows.first().obs_id
    new = enrich.enrich(rows, lambda ask: '{"observations": [{"obs_id": "%s", "content": "new", "source": ""}]}' % one)
    assert {r.content for r in new.where(F.col("obs_id") == one).collect()} == {"new"}


def test_command_line(spark, tmp_path):
    assert cli.main(["generate", "--batch", "3", "--validate", "--output", str(tmp_path / "g")]) == 0
    assert cli.main(["resolve", "--input", str(tmp_path / "g/observations"), "--output", str(tmp_path / "r")]) == 0
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_variants_and_inferred_actions(spark):
    bank = {a: pool for kind, a, pool in dims.phrases() if kind == "variant"}
    sentences = {x for kind, _, pool in dims.phrases() if kind in generate.MODALITIES for x in pool}
    assert set(bank) <= sentences and len(bank) == 3 * len({s[3] for slots in dims.SLOTS.values() for s in slots})
    case = generate.cases(spark, 60)
    clean = generate.clean_observations(case, generate.entities(case), generate.timeline(case))
    rows = generate.noisy(clean).join(clean.select("case_no", "n", F.col("content").alias("was")), ["case_no", "n"]).collect()
    varied = [r for r in rows if "semantic_variation" in r.noise_tags]
    assert {r.modality for r in varied} == {"video", "audio", "text"}
    assert all(r.content in bank[r.was] if r.was in bank else r.modality == "video" and r.content.startswith(r.was[:-1]) for r in varied)
    texts = [("He ENTERed, then ran", "enter_atm"), ("transfer files", "steal_data"), ("files", "steal_items"), ("run", "flee_scene"), ("", "unknown_action"), (None, "unknown_action")]
    got = [r[0] for r in spark.createDataFrame([(t,) for t, _ in texts], "content string").select(generate.inferred_action(F.col("content"))).collect()]
    assert got == [a for _, a in texts]
    told = {r.obs_id for r in generate.noisy(clean.drop("action")).collect()}
    assert told == {r.obs_id for r in rows}
    assert all(len(set(dims.descriptions(d, t))) == 12 for d, t in dims.SLOTS)


def test_strict_validation(spark, docs):
    assert generate.checked(docs).count() == 80
    bad = docs.limit(1).withColumn("ground_truth", F.col("ground_truth").withField("entities", F.slice("ground_truth.entities", 1, 1)))
    found = generate.validated(bad).first().errors
    assert "fewer witnesses than the template needs" in found and "witnesses differ from the report" in found
    with pytest.raises(Exception, match="fewer witnesses"):
        generate.checked(bad).collect()


def test_enrichment_of_whole_cases(spark, docs):
    two = docs.limit(2).cache()
    kept = enrich.enrich_cases(two, lambda ask: "no JSON")
    assert [r.fir.enriched for r in kept.collect()] == [False, False]
    same = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("case_id", "observations", "ground_truth"))).collect())
    assert same(kept) == same(two)

    def service(ask):
        import json

        seen = json.loads(ask)
        return "```json" + json.dumps({"fir": {"description": "told anew", "location": " "}, "observations": [{"obs_id": seen["observations"][0]["obs_id"], "content": "other words", "source": ""}, {"obs_id": "none"}]}) + "```"

    for old, new in zip(sorted(two.collect(), key=lambda r: r.case_id), sorted(enrich.enrich_cases(two, service).collect(), key=lambda r: r.case_id), strict=True):
        assert new.fir.enriched and new.fir.description == "told anew" and new.fir.location == old.fir.location
        first, *rest = new.observations
        assert first.content == "other words" and first.source == old.observations[0].source and first.obs_id == old.observations[0].obs_id
        assert [tuple(o) for o in rest] == [tuple(o) for o in old.observations[1:]] and new.ground_truth == old.ground_truth


def test_printed_cases(spark, docs, capsys, tmp_path):
    assert cli.main(["generate", "--batch", "2", "--domain", "Communication"]) == 0
    out = capsys.readouterr().out
    assert out.count('"case_id"') == 2 and '\n  "domain"' in out
    (tmp_path / "evidentia_test_service.py").write_text("def quiet(ask):\n    raise OSError\n")
    spark.sparkContext.addPyFile(str(tmp_path / "evidentia_test_service.py"))
    assert cli.main(["generate", "--enrich", "evidentia_test_service:quiet", "--output", str(tmp_path / "g")]) == 0
