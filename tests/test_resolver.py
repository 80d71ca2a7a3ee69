import json
import random
from unittest.mock import MagicMock

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidentia import adapters, queries
from evidentia.config import ErConfig
from evidentia.functions import scorers
from evidentia.functions.similarity import lcs, token_set_ratio, token_sort_ratio
from evidentia.functions.text import alias_norm, epoch
from evidentia.operators import blocking, clusters, intake, scoring
from evidentia.operators.entities import Resolution, resolve_entities
from evidentia.schema import CONSTRAINT, HINT, RAW
from evidentia.sources import cases as files
from evidentia.streaming import intake as streaming


def raw(spark, rows, case="K"):
    names = "obs_id entity role modality location content timestamp confidence".split()
    base = {"role": "suspect", "modality": "video", "location": "", "content": "", "timestamp": "2024-01-15T10:00:00", "confidence": "0.5"}
    return spark.createDataFrame([(r.get("case_id", case), i, *((base | r).get(n) for n in names)) for i, r in enumerate(rows)], RAW)


def test_ratios_by_hand():
    assert lcs("kitten", "sitting") == 4 and lcs("", "a") == 0 and lcs("é" * 200, "é" * 150) == 150
    assert token_sort_ratio("b a", "a b") == 1.0
    assert token_set_ratio("a b c", "b c") == 1.0 and token_set_ratio("", "a") == 0.0 and token_set_ratio(" ", " ") == 0.0
    # shared "red jacket"; rests "man" and "woman": 3 of 8 characters' worth differ by 2
    assert token_set_ratio("red jacket man", "woman red jacket") == pytest.approx(1 - 2 / 30)
    assert token_set_ratio("abc", "abd") == pytest.approx(1 - 2 / 6)


def test_text_expressions(spark):
    df = spark.createDataFrame([(" Person 97.x\t",), ("É_a",)], "e string")
    assert [r[0] for r in df.select(alias_norm(F.col("e"))).collect()] == ["person_97_x", "__a"]
    times = ["2024-01-15T10:00:00", "2024-01-15T10:00:00Z", "2024-01-15T12:00:00+02:00", "2024-01-15T08:30:00-0130", "2024-01-15 10:00:00", " 2024-1-15T10:0:0 ", "2024-01-15T10:00:00.5", "2024-01-15 10:00:00Z", "2024-13-15T10:00:00", "soon", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(epoch(F.col("t"))).collect()]
    assert got == [1705312800.0] * 6 + [0.0] * 5


def test_intake(spark):
    df = raw(spark, [{"obs_id": "a", "entity": "X", "confidence": "0.4"}, {"obs_id": "b", "entity": "X", "confidence": "0.9"}, {"obs_id": "c", "entity": "X", "confidence": "0.9"}, {"obs_id": None, "entity": "Y"}, {"obs_id": "d", "entity": None}, {"obs_id": "e", "entity": "Z", "confidence": "high"}, {"obs_id": "f", "entity": "Z", "confidence": "NaN", "timestamp": "x"}, {"obs_id": "g", "entity": "W", "confidence": "-3", "timestamp": "2024-01-15T10:01:00"}])
    obs = {r.obs_id: r for r in intake.observations(df).collect()}
    assert set(obs) == {"b", "f", "g"} and obs["b"].ord == 0 and obs["g"].confidence == 0.0 and obs["f"].confidence == 1.0
    assert obs["g"].time_offset_sec == 60 and obs["f"].time_offset_sec == 0 and obs["f"].ts_epoch == 0
    assert {r.reason for r in intake.quarantine(df).collect()} == {"no obs_id", "no entity", "confidence is no number"}
    assert {r.obs_id for r in intake.observations(df, check_duplicates=False).collect()} == {"a", "b", "c", "f", "g"}


def test_demo_results(spark):
    r = Resolution(adapters.demo_observations(spark))
    w = {(e.case_id[5:7], e.obs_id_1, e.obs_id_2): e for e in r.edges.collect()}
    for key, weight, cls in ((("IP", "L1", "T1"), 0.454, "rejected"), (("IP", "T1", "V1"), 0.638, "possible"), (("IP", "L1", "V1"), 0.671, "likely"), (("IP", "V1", "W1"), 0.493, "rejected"), (("IP", "T1", "W1"), 0.435, "rejected"), (("IP", "L1", "W1"), 0.421, "rejected"), (("AT", "O16", "O17"), 0.609, "possible")):
        assert w[key].weight == pytest.approx(weight, abs=6e-4) and w[key].classification == cls
    docs = {d.case_id: d for d in r.documents().collect()}
    ip, atm = docs["CASE_IP_CROSSMODAL_001"], docs["CASE_ATM_004"]
    assert ip.status == "success" and ip.entity_count == 2 and ip.conflicts_detected == 0
    suspect = next(e for e in ip.canonical_entities if e.roles == ["suspect"])
    assert len(suspect.aliases) == 3 and suspect.modalities == ["text", "video"] and suspect.confidence_score == pytest.approx(0.87) and suspect.time_span_seconds == 190 and suspect.candidate_mentions == []
    assert atm.status == "awaiting_human_validation" and atm.entity_count <= 3 and atm.conflicts_detected >= 1
    assert len(next(e for e in atm.canonical_entities if "suspect" in e.roles).aliases) >= 2
    assert [c.type for c in r.conflicts.where("case_id = 'CASE_ATM_004'").collect()] == ["low_confidence"]
    assert set(r.timeline().columns) == {"case_id", "canonical_entities", "clusters", "conflicts_detected"}


def test_constraints_force_inclusion_only(spark):
    df = raw(spark, [{"obs_id": "a", "entity": "P Q"}, {"obs_id": "b", "entity": "R", "timestamp": "2024-01-15T23:00:00"}, {"obs_id": "c", "entity": "S", "timestamp": "2024-01-15T10:00:10"}])
    obs = intake.observations(df)
    merge = spark.createDataFrame([("K", "r", " p q ")], CONSTRAINT)
    apart = spark.createDataFrame([("K", "P_Q", "S"), ("K", "R", "p q")], CONSTRAINT)
    key = lambda d: sorted((r.obs_id_1, r.obs_id_2, r.forced) for r in d.collect())
    assert key(blocking.candidates(obs, ErConfig(), merge)) == [("a", "b", True), ("a", "c", False)]
    assert key(blocking.candidates(obs, ErConfig(), merge, apart)) == []
    assert key(blocking.candidates(obs, ErConfig(max_pairs=1), merge)) == [("a", "b", True)]
    r = Resolution(df, must_merge=merge)
    assert r.edges.where("obs_id_1 = 'a' and obs_id_2 = 'b'").first().classification == "rejected"
    hint = spark.createDataFrame([("K", "p_q", "s", 5.0)], HINT)
    assert Resolution(df, soft_hints=hint).edges.where("obs_id_2 = 'c'").first().weight == 1.0
    with pytest.raises(ValueError):
        Resolution(df, ErConfig(temporal_window_sec=0))


def test_attachment_folds_in_order(spark):
    members = spark.createDataFrame([("K", "C1", "a", 1), ("K", "C1", "b", 2), ("K", "C2", "s", 1), ("K", "C3", "t", 1)], clusters.CLUSTER)
    schema = "case_id string, obs_id_1 string, obs_id_2 string, alias_1 string, alias_2 string, weight double, classification string, reasons array<string>"
    edges = spark.createDataFrame([("K", "a", "s", "A", "S", 0.75, "likely", ["x"]), ("K", "b", "t", "B", "T", 0.6, "possible", []), ("K", "s", "t", "S", "T", 0.71, "likely", []), ("K", "a", "b", "A", "B", 0.9, "confirmed", [])], schema)
    got, mentions = clusters.attach(members, edges, ErConfig())
    assert sorted((r.cluster_id, r.member_ord, r.obs_id) for r in got.collect()) == [("C1", 1, "a"), ("C1", 2, "b"), ("C1", 3, "s"), ("C1", 4, "t")]
    assert sorted((r.obs_id, r.candidate_alias, r.score) for r in mentions.collect()) == [("b", "T", 0.6), ("t", "B", 0.6)]


def test_conflicts(spark):
    df = raw(spark, [{"obs_id": "a", "entity": "P", "location": "Here", "confidence": "0.9"}, {"obs_id": "b", "entity": "P", "location": "there", "modality": "audio", "confidence": "0.9"}])
    obs = intake.observations(df)
    members = spark.createDataFrame([("K", "C1", "a", 1), ("K", "C1", "b", 2)], clusters.CLUSTER)
    assert clusters.physical_impossibilities(members, obs).count() == 1
    sizes = spark.createDataFrame([("K", f"C{i}", 1) for i in range(11)] + [("K", "C11", 40)], "case_id string, cluster_id string, size long")
    assert [r.cluster_id for r in clusters.oversized(sizes, 3.0).collect()] == ["C11"]
    assert clusters.oversized(sizes.where("size = 40"), 3.0).count() == 0


def test_bucketed_blocking_equals_the_join(spark):
    obs = intake.observations(adapters.adapted(spark, "/root/testdata/sf0.001", "event"))
    cfg = ErConfig(temporal_window_sec=1800, max_temporal_gap_sec=7200)
    a, b = (sorted(map(tuple, f(obs, cfg).select("case_id", "obs_id_1", "obs_id_2").collect())) for f in (blocking.pairs_by_join, blocking.pairs_by_buckets))
    assert a and a == b


def test_scorers(spark):
    assert scorers.parse_scores('```json\n{"0": 0.5, "1": "2", "x": 1, "2": null}\n```') == {0: 0.5, 1: 1.0} and scorers.parse_scores("no") == {}
    calls = []

    def service(pairs):
        calls.append(len(pairs))
        return json.dumps({"0": 0.9})

    fn = scorers.batch_scorer(service, fallback=lambda a, b: 0.1, chunk=2)
    df = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "b")], "content_a string, content_b string").coalesce(1)
    assert [round(r[0], 3) for r in df.select(fn(df)).collect()] == [0.9, 0.1, 0.9]
    broken = scorers.batch_scorer(lambda pairs: 1 / 0, fallback=lambda a, b: 0.2)
    r = Resolution(adapters.demo_observations(spark), scorers={"entity_coreference": broken})
    assert {round(e.entity_coreference, 3) for e in r.edges.collect()} == {0.2}


def test_case_files(spark, tmp_path):
    case = {"case_id": "", "domain": "d", "observations": [{"obs_id": "O1", "entity": "A", "confidence": 0.7, "x": 1}, {"obs_id": "O2", "entity": "A", "confidence": "bad"}, {"entity": "B"}]}
    (tmp_path / "c.json").write_text(json.dumps(case, indent=1))
    rows = files.read_cases(spark, str(tmp_path / "c.json"))
    assert {r.case_id for r in intake.clean(rows).collect()} == {"UNKNOWN_CASE"} and intake.quarantine(rows).count() == 2
    docs = spark.createDataFrame([Row(case_id="Z", observations=[Row(obs_id="1", entity="E", role=None, modality=None, location=None, content=None, timestamp=None, confidence=None)])], "case_id string, observations array<struct<obs_id:string,entity:string,role:string,modality:string,location:string,content:string,timestamp:string,confidence:string>>")
    out = resolve_entities(docs).first()
    assert out.entity_count == 1 and out.canonical_entities[0].roles == ["unknown"] and out.canonical_entities[0].earliest_timestamp == ""
    files.write_results(resolve_entities(docs), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert resolve_entities(docs.limit(0)).count() == 0


def test_streaming(spark, tmp_path):
    adapters.demo_observations(spark).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW).json(str(tmp_path / "in"))
    q = streaming.distinct_stream(stream.union(stream)).writeStream.format("memory").queryName("distinct_obs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("distinct_obs").count() == 14
    seen = []
    q = streaming.resolve_stream(stream, lambda df, n: seen.append(df.count()), checkpointLocation=str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 4


def test_queries_read_whole_turns(spark, tmp_path, monkeypatch):
    start = " ".join(f"w{i}" for i in range(60))
    turns = [(0, 0, "user", start + " entered the booth"), (0, 1, "user", start + " entered the server")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    whole = {r.obs_id: r.content for r in adapters.adapted(spark, str(tmp_path)).collect()}
    assert whole == {"O0": turns[0][3], "O1": turns[1][3], "R0": turns[0][3]}
    ratio = scoring.with_ratios(blocking.candidates(intake.observations(adapters.adapted(spark, str(tmp_path))), ErConfig())).where("obs_id_1 = 'O0' and obs_id_2 = 'O1'").select("content_ratio", "context_ratio").collect()
    assert [round(r[0], 9) for r in ratio] == [round(token_set_ratio(turns[0][3], turns[1][3]), 9)] != [1.0] and ratio[0][1] == 1.0  # the first 120 characters are equal
    read = []
    monkeypatch.setattr(queries, "Resolution", lambda raw, cfg=None: read.append(raw) or MagicMock())
    for name in ("attachment", "er_entities", "er_documents", "er_conflicts", "timeline_payload"):
        queries.QUERIES[name](spark, str(tmp_path))
    assert all({r.content for r in raw.collect()} == set(whole.values()) for raw in read) and len(read) == 5


def fold(members, edges, least):
    """The attachment rule, literally: (case, cluster) -> members in order, and mentions."""
    of = {m: c for c, ms in members.items() for m in ms}
    mentions = []
    for one, two, a1, a2, w in sorted(edges):
        single = [len(members[of[one]]) == 1, len(members[of[two]]) == 1]
        for yes, x, y, ax, ay in ((single[0], one, two, a1, a2), (single[1], two, one, a2, a1)):
            if yes and w >= least:
                members[of[y]].append(x)
                members[of[x]].remove(x)
                of[x] = of[y]
            elif yes:
                mentions += [(x, ay, round(w, 4)), (y, ax, round(w, 4))]
    return {(c, i + 1, m) for c, ms in members.items() for i, m in enumerate(ms)}, mentions


def test_attachment_against_a_literal_fold(spark):
    rng = random.Random(3)
    members, edges, want = [], [], {}
    for case in range(60):
        ids = [f"o{i}" for i in range(rng.randint(2, 12))]
        groups = {}
        for i in ids:
            groups.setdefault(f"C{rng.randint(1, len(ids))}", []).append(i)
        pairs = [(a, b, f"A{a}", f"A{b}", rng.choice([0.5, 0.69, 0.7, 0.75])) for i, a in enumerate(ids) for b in ids[:i] if rng.random() < 0.4]
        pairs = [(*sorted(p[:2]), *p[2:]) for p in pairs]
        members += [(str(case), c, m, i + 1) for c, ms in groups.items() for i, m in enumerate(ms)]
        edges += [(str(case), *p, "likely" if p[4] > 0.65 else "possible", ["r"]) for p in pairs]
        want[str(case)] = fold({c: list(ms) for c, ms in groups.items()}, pairs, 0.7)
    edges.append(("0", *edges[0][1:5], 0.95, "confirmed", []))
    e = spark.createDataFrame(edges, "case_id string, obs_id_1 string, obs_id_2 string, alias_1 string, alias_2 string, weight double, classification string, reasons array<string>")
    got, mentions = clusters.attach(spark.createDataFrame(members, clusters.CLUSTER), e, ErConfig())
    rows, said = got.collect(), sorted(mentions.collect(), key=lambda r: r.mention_ord)
    for case, (m, x) in want.items():
        assert {(r.cluster_id, r.member_ord, r.obs_id) for r in rows if r.case_id == case} == m
        assert [(r.obs_id, r.candidate_alias, r.score) for r in said if r.case_id == case] == x


def test_failures_are_reported_and_timings_told(spark):
    df = raw(spark, [{"obs_id": "a", "entity": "P", "content": "x"}, {"obs_id": "b", "entity": "Q", "content": "y"}])
    cases = df.groupBy("case_id").agg(F.collect_list(F.struct(*df.columns[2:])).alias("observations"))

    def broken(pairs):
        return F.raise_error(F.lit("the scorer is down")).cast("double")

    failed = resolve_entities(cases, report_failure=True, scorers={"context": broken}).collect()
    assert [(r.case_id, r.status, r.entity_count) for r in failed] == [("K", "failed", 0)] and "the scorer is down" in failed[0].error_message
    good = resolve_entities(cases, report_failure=True)
    assert good.columns == list(failed[0].asDict()) and good.first().status != "failed"
    r = Resolution(df)
    times = r.timings()
    doc = r.documents(times).first()
    assert doc.stage_timings == times and doc.total_processing_time_sec == pytest.approx(sum(times.values()))
    r.close()


def test_scores_from_nested_and_wordy_answers():
    assert scorers.parse_scores('Sure {not json} ```json\n{"0": 0.5, "note": {"a": 1}, "1": "2"}\n``` done {}') == {0: 0.5, 1: 1.0}
    assert scorers.parse_scores("{") == {} and scorers.parse_scores("") == {} and scorers.parse_scores('{"0": null, "x": 1, "2": [1]}') == {}


def counted(pairs):
    p = pairs.groupBy("case_id").agg(F.count("*").alias("n"), F.sum(blocking.gap()).alias("gap"))
    return {r.case_id: (r.n, r.gap) for r in p.collect()}


OBS = "case_id string, ord long, obs_id string, entity_norm string, role string, modality string, location string, time_offset_sec long"


@pytest.mark.parametrize(("near", "wide"), [(300, 3600), (0, 60), (600, 600), (900, 300), (-1, 200), (-1, -1), (100_000, 400_000)])
def test_pair_totals_against_the_join(spark, near, wide):
    """Blank and differently written places and roles, times of several days, places in the case that two share, a lone observation and a null case."""
    rng = random.Random(near + wide)
    rows = [(case, rng.randrange(60), f"O{i}", "x", rng.choice(["suspect", " Suspect", "witness"]), rng.choice(["video", "Video", "audio", "text"]), rng.choice(["", " ", "Room", "room ", "hall"]), rng.choice([0, 0, rng.randrange(900), rng.randrange(300_000)])) for case in ("A", "B", None) for i in range(80)]
    obs = spark.createDataFrame([*rows, ("C", 1, "O", "x", "r", "video", "Room", 5)], OBS)
    cfg = ErConfig(temporal_window_sec=near, max_temporal_gap_sec=wide)
    want = counted(blocking.pairs_by_join(obs, cfg))
    assert set(want) == {"A", "B"}
    assert {r.case_id: (r.n_pairs, r.total_gap) for r in blocking.pair_totals(obs, cfg).collect()} == want
    assert blocking.pair_totals(obs.limit(0), cfg).count() == 0


def test_large_case_is_counted_without_its_pairs(spark):
    """300,000 observations of a case at one place: 45 billion pairs."""
    n = 300_000
    obs = spark.range(n).selectExpr("'A' case_id", "id ord", "cast(id as string) obs_id", "'x' entity_norm", "'suspect' role", "'video' modality", "'Room' location", "id time_offset_sec")
    assert [tuple(r) for r in blocking.pair_totals(obs, ErConfig()).collect()] == [("A", n * (n - 1) // 2, (n - 1) * n * (n + 1) // 6)]
