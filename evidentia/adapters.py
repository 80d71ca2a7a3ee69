"""The driver's tables as raw observations, and the built-in demo cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.schema import RAW

_MODALITY = "element_at(array('video', 'audio', 'text'), 1 + cast({0} % 3 as int))"
_PLACE = "element_at(array('ATM booth entrance', 'atm booth interior', 'Server room 3', ''), 1 + cast({0} % 4 as int))"
_ROLE = "case role when 'user' then 'suspect' when 'assistant' then 'witness' else role end"


def conversation_observations(conversations: DataFrame) -> DataFrame:
    """Each conversation a case, each turn an observation 40 seconds after the one before, its content the whole text; a quarter of the turns are reported again, 20 seconds later and in another modality."""
    entity = f"case when turn % 4 < 2 then concat({_ROLE}, ' ', cast(conv_id % 5 as string)) else concat('Speaker_', chr(65 + cast(turn % 3 as int))) end"
    return conversations.withColumn("again", F.explode(F.expr("case when (turn + conv_id) % 4 = 0 then array(0, 1) else array(0) end"))).selectExpr(
        "cast(conv_id as string) case_id",
        "cast(turn * 2 + again as long) ord",
        "concat(if(again = 1, 'R', 'O'), cast(turn as string)) obs_id",
        f"{entity} entity",
        f"{_ROLE} role",
        f"{_MODALITY.format('(turn + conv_id + again)')} modality",
        f"{_PLACE.format('(turn + conv_id)')} location",
        "coalesce(text, '') content",
        "date_format(timestamp_seconds(1705312800 + turn * 40 + again * 20), \"yyyy-MM-dd'T'HH:mm:ss\") timestamp",
        "cast((conv_id * 7 + turn * 13 + again * 29) % 100 / 100.0D as string) confidence",
    )


def event_observations(events: DataFrame) -> DataFrame:
    """Each day a case, each event an observation; some rows are malformed on purpose, and times are cut to minutes, so that rows repeat."""
    return events.selectExpr(
        "date_format(ts, 'yyyy-MM-dd') case_id",
        "cast(event_id as long) ord",
        "case when event_id % 97 <> 0 then concat('E', cast(event_id as string)) end obs_id",
        "concat('User ', cast(user_id % 40 as string)) entity",
        "case when event_type in ('click', 'view') then 'suspect' else 'witness' end role",
        f"{_MODALITY.format('event_id')} modality",
        f"{_PLACE.format('user_id')} location",
        "concat('saw ', event_type) content",
        "case when event_id % 41 = 0 then 'unknown' when event_id % 43 = 0 then date_format(ts, \"yyyy-MM-dd HH:mm:'00'\") else date_format(ts, \"yyyy-MM-dd'T'HH:mm:'00Z'\") end timestamp",
        "case when event_id % 89 = 0 then 'high' when event_id % 83 <> 0 then cast(floor(value) / 100.0D as string) end confidence",
    )


_DEMO = [
    ("CASE_ATM_004", [
        ("O1", "Person_97", "suspect", "video", "ATM booth entrance, exterior facing", "Individual seen walking towards ATM kiosk (captured on footage).", "2024-01-15T10:01:20", "0.906"),
        ("O2", "Speaker_K", "suspect", "audio", "near ATM location, mobile network", "I can see the booth from here.", "2024-01-15T10:01:12", "0.613"),
        ("O3", "sms_35", "suspect", "text", "remote — email server log", "Heading there. Any activity?", "2024-01-15T10:00:55", "0.683"),
        ("O7", "Person_97", "suspect", "video", "ATM booth interior, card reader and keypad area", "Suspect enters the ATM booth unaccompanied (captured on footage).", "2024-01-15T10:03:54", "0.875"),
        ("O8", "Speaker_K", "suspect", "audio", "ATM vicinity, intercepted channel", "I'm in, it's clear.", "2024-01-15T10:03:56", "0.778"),
        ("O9", "sms_35", "suspect", "text", "local police station, complaint desk", "Entered. Starting now.", "2024-01-15T10:04:06", "0.730"),
        ("O14", "Speaker_K", "suspect", "audio", "ATM vicinity, intercepted channel", "Done, I'm coming out.", "2024-01-15T10:04:58", "0.836"),
        ("O15", "sms_35", "suspect", "text", "bank security office, incident registry", "Exited. Don't wait for me.", "2024-01-15T10:04:57", "0.785"),
        ("O16", "Person_32", "witness", "video", "ATM lobby doorway, entry/exit point", "Eyewitness notices a person leaving the ATM enclosure in a rush.", "2024-01-15T10:05:09", "0.482"),
        ("O17", "Person_32", "witness", "video", "ATM booth entrance, exterior facing", "Bystander seen speaking with bank security personnel outside.", "2024-01-15T10:08:44", "0.501"),
    ]),
    ("CASE_IP_CROSSMODAL_001", [
        ("T1", "Suspect A", "suspect", "text", "interview room transcript", "Suspect A stated they accessed the server at 14:02.", "2024-03-01T14:05:00", "0.82"),
        ("L1", "192.168.4.22", "suspect", "text", "firewall log / dmz segment", "SSH login accepted from 192.168.4.22 at 14:02:11.", "2024-03-01T14:02:11", "0.91"),
        ("V1", "individual_in_red_jacket", "suspect", "video", "server room hallway camera 3", "Individual in red jacket badged into server room at 14:01:50.", "2024-03-01T14:01:50", "0.88"),
        ("W1", "Security Guard", "witness", "audio", "server room entrance", "Guard reports unknown person in red jacket near rack 4.", "2024-03-01T14:03:00", "0.74"),
    ]),
]


def demo_observations(spark: SparkSession) -> DataFrame:
    """Fixed example cases whose results the tests hold: a cash-machine case and one of an address, a transcript and a camera."""
    return spark.createDataFrame([(case, i, *row) for case, rows in _DEMO for i, row in enumerate(rows)], RAW)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, kind: str = "conv") -> DataFrame:
    """kind: conv, conversations; event, events."""
    return event_observations(table(spark, sf_dir, "events")) if kind == "event" else conversation_observations(table(spark, sf_dir, "conversations"))


def example_constraints(spark: SparkSession, raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """must_merge, must_not_merge and soft hints for adapted conversations, made from their own case ids."""
    cases = raw.select("case_id").distinct()
    merge = cases.where(F.col("case_id").cast("long") % 3 == 0).select("case_id", F.lit("Speaker_A").alias("alias_a"), F.lit("Speaker_B").alias("alias_b"))
    apart = cases.where(F.col("case_id").cast("long") % 4 == 0).select("case_id", F.lit("speaker A").alias("alias_a"), F.lit("Speaker_C").alias("alias_b"))
    hints = cases.where(F.col("case_id").cast("long") % 5 == 0).select("case_id", F.lit("speaker_a").alias("alias_lo"), F.lit("speaker_c").alias("alias_hi"), F.lit(0.15).alias("hint"))
    return merge, apart, hints
