"""Dimensions of the generator: domains, templates, slots, sources, places, weights, and phrase pools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE_TIME = "2024-01-15T10:00:00"


@dataclass(frozen=True)
class NoiseConfig:
    """Fixed default rates."""

    temporal_noise_min_sec: int = 3
    temporal_noise_max_sec: int = 8
    missing_modality_rate: float = 0.20
    contradiction_rate: float = 0.075
    temporal_noise_rate: float = 0.60
    semantic_variation_rate: float = 0.40


# Structure and numbers that generated cases share with every other producer of them.
WINDOWS = {"ATM_Robbery": (300, 900), "Office_Theft": (600, 86400), "Communication": (3600, 86400)}

#: (domain, template): (slot, role, index within the role, action, required, least and most seconds after the event before)
SLOTS = {
    ("ATM_Robbery", "Entry_Action_Exit"): [
        ("approach", "suspect", 0, "approach_atm", True, 5, 30), ("entry", "suspect", 0, "enter_atm", True, 10, 40), ("transaction", "suspect", 0, "withdraw_cash", True, 20, 120),
        ("loiter_post", "suspect", 0, "wait_outside", True, 10, 40), ("exit", "suspect", 0, "exit_atm", True, 10, 50), ("witness_observes", "witness", 0, "observe_exit", True, 5, 30),
        ("witness_reports", "witness", 0, "report_incident", False, 30, 300),
    ],
    ("ATM_Robbery", "MultiActor_Entry_Action_Exit"): [
        ("suspect1_approach", "suspect", 0, "approach_atm", True, 5, 20), ("suspect2_approach", "suspect", 1, "approach_atm", True, 5, 20), ("suspect1_entry", "suspect", 0, "enter_atm", True, 10, 30),
        ("suspect2_wait", "suspect", 1, "wait_outside", True, 5, 20), ("transaction", "suspect", 0, "withdraw_cash", True, 30, 120), ("suspect1_exit", "suspect", 0, "exit_atm", True, 10, 30),
        ("both_flee", "suspect", 1, "flee_scene", True, 5, 20), ("witness_observes", "witness", 0, "observe_exit", False, 5, 25), ("witness2_reports", "witness", 1, "report_incident", False, 30, 300),
    ],
    ("ATM_Robbery", "Entry_Suspicious_Exit"): [
        ("approach", "suspect", 0, "approach_atm", True, 5, 20), ("loiter", "suspect", 0, "loiter_near_atm", True, 30, 180), ("entry", "suspect", 0, "enter_atm", True, 10, 30),
        ("suspicious_action", "suspect", 0, "tamper_atm", True, 20, 90), ("exit", "suspect", 0, "exit_atm", True, 5, 20), ("witness_observes", "witness", 0, "observe_exit", True, 5, 25),
        ("witness_reports", "witness", 0, "report_incident", False, 60, 600),
    ],
    ("Office_Theft", "Entry_HiddenAction_Exit"): [
        ("approach_building", "suspect", 0, "approach_office", True, 10, 60), ("entry", "suspect", 0, "enter_office", True, 10, 60), ("navigate", "suspect", 0, "navigate_to_target", True, 20, 120),
        ("theft", "suspect", 0, "steal_items", True, 30, 300), ("exit", "suspect", 0, "exit_office", True, 10, 60), ("witness_observes", "witness", 0, "observe_exit", True, 20, 180),
        ("witness_reports", "witness", 0, "report_incident", False, 300, 3600),
    ],
    ("Office_Theft", "Entry_LegitAction_HiddenAction_Exit"): [
        ("approach_building", "suspect", 0, "approach_office", True, 10, 60), ("entry", "suspect", 0, "enter_office", True, 10, 60), ("legit_work", "suspect", 0, "perform_legit_work", True, 1800, 7200),
        ("hidden_action", "suspect", 0, "steal_data", True, 60, 600), ("exit", "suspect", 0, "exit_office", True, 10, 60), ("witness_observes", "witness", 0, "observe_exit", True, 5, 120),
        ("witness_reports", "witness", 0, "report_incident", False, 300, 7200),
    ],
    ("Communication", "Communication_Action_Consequence"): [
        ("initiate_comm", "suspect", 0, "initiate_communication", True, 60, 3600), ("exchange", "suspect", 0, "exchange_information", True, 120, 1800), ("plan_confirmed", "suspect", 0, "confirm_plan", True, 300, 3600),
        ("suspect_follow_up", "suspect", 0, "coordinate_activity", True, 300, 7200), ("witness_flags", "witness", 0, "flag_suspicious_comm", True, 1800, 86400), ("witness_reports", "witness", 0, "report_incident", True, 600, 7200),
    ],
    ("Communication", "MultiActor_Communication"): [
        ("suspect1_initiate", "suspect", 0, "initiate_communication", True, 60, 1800), ("suspect2_respond", "suspect", 1, "respond_to_communication", True, 300, 3600), ("coordinate", "suspect", 0, "coordinate_activity", True, 300, 7200),
        ("suspect2_confirm", "suspect", 1, "confirm_plan", True, 300, 3600), ("witness_intercept", "witness", 0, "intercept_communication", True, 600, 14400), ("witness_reports", "witness", 0, "report_incident", True, 600, 7200),
    ],
}

#: Words in a content, the first that is found first, and the action they stand for where no event tells it.
KEYWORD_ACTIONS = [
    ("enter", "enter_atm"), ("inside", "enter_atm"), ("withdraw", "withdraw_cash"), ("transaction", "withdraw_cash"), ("exit", "exit_atm"), ("leave", "exit_atm"), ("steal", "steal_items"),
    ("transfer", "steal_data"), ("tamper", "tamper_atm"), ("approach", "approach_atm"), ("message", "initiate_communication"), ("plan", "confirm_plan"), ("files", "steal_items"), ("loiter", "loiter_near_atm"),
    ("pacing", "loiter_near_atm"), ("coordinate", "coordinate_activity"), ("navigate", "navigate_to_target"), ("server", "navigate_to_target"), ("fleet", "flee_scene"), ("run", "flee_scene"),
]
NO_ACTION = "unknown_action"
WEIGHTS = {("suspect", "video"): 0.70, ("suspect", "audio"): 0.50, ("suspect", "text"): 0.40, ("witness", "video"): 0.25, ("witness", "audio"): 0.75, ("witness", "text"): 0.50, ("system", "video"): 0.0, ("system", "audio"): 0.0, ("system", "text"): 1.0}
CONFIDENCE = {("suspect", "video"): (0.75, 0.95), ("suspect", "audio"): (0.60, 0.85), ("suspect", "text"): (0.65, 0.90), ("witness", "video"): (0.40, 0.70), ("witness", "audio"): (0.70, 0.90), ("witness", "text"): (0.65, 0.85)}
SOURCES = {"video": ["camera_1", "camera_2", "camera_3", "cctv_entrance", "cctv_atm"], "audio": ["mic_booth", "phone_record", "witness_statement", "intercepted_call"], "text": ["email_log", "sms_record", "complaint_register", "incident_report"]}
# ---- own words ------------------------------------------------------------------------------------------------------------------

_SITE = {"ATM_Robbery": "ATM branch", "Office_Theft": "office block", "Communication": "watched line"}
_SPOT = {
    "camera_1": "front step", "camera_2": "pavement", "camera_3": "far kerb", "cctv_entrance": "swing door", "cctv_atm": "inner room",
    "mic_booth": "wall microphone", "phone_record": "handset nearby", "witness_statement": "where a passer-by stood", "intercepted_call": "tapped call",
    "email_log": "mail archive", "sms_record": "text messages", "complaint_register": "front counter", "incident_report": "shift book",
}
#: Places of (domain, modality), in the order of the modality's sources.
PLACES = {(d, m): [f"{site}, {_SPOT[s]}" for s in sources] for d, site in _SITE.items() for m, sources in SOURCES.items()}
NO_PLACE = "location unspecified"

# ---- phrase pools, by rule ------------------------------------------------------------------------------------------------------

_OBJECTS = {"atm": "the cash machine", "office": "the office building", "cash": "cash from the machine", "outside": "near the doorway", "scene": "the area", "target": "the inner rooms", "items": "goods from a desk", "data": "files onto a drive", "work": "ordinary work", "communication": "a call", "information": "details", "plan": "the plan", "activity": "the next step", "comm": "an odd message", "exit": "someone leaving", "incident": "the matter"}


def _said(action: str) -> tuple[str, str]:
    verb, *rest = action.split("_")
    return verb, _OBJECTS.get(rest[-1] if rest else "", "something")


def phrases() -> list[tuple[str, str, list[str]]]:
    """(kind, action, pool): pools of sentences for each action, of remarks for contradictions, and of other words for the first sentence of a pool (kind variant, which stands in for the action)."""
    out = []
    for action in sorted({s[3] for slots in SLOTS.values() for s in slots}):
        verb, what = _said(action)
        out += [
            ("video", action, [f"One person is seen to {verb} {what}.", f"Footage shows a figure who moves to {verb} {what}.", f"A figure in dark clothes appears to {verb} {what}."]),
            ("audio", action, [f"I am about to {verb} {what}.", f"Listen, time to {verb} {what} now.", f"Someone here said they {verb} {what}."]),
            ("text", action, [f"Going to {verb} {what}.", f"Note: {verb} {what}, as agreed.", f"Entry reads: {verb} {what}."]),
            ("variant", f"One person is seen to {verb} {what}.", [f"On screen, somebody begins to {verb} {what}.", f"The camera has a person ready to {verb} {what}."]),
            ("variant", f"I am about to {verb} {what}.", [f"In a moment I will {verb} {what}.", f"Next I {verb} {what}."]),
            ("variant", f"Going to {verb} {what}.", [f"Off to {verb} {what}.", f"Will {verb} {what} shortly."]),
            ("denial", action, [f"Nobody did {verb} {what}.", f"It is not true that anyone went to {verb} {what}.", f"I never saw a person {verb} {what}."]),
        ]
    out.append(("video_quality", "", ["The picture is too grainy to tell.", "Frames are missing from this clip.", "Glare hides the face."]))
    out.append(("text_integrity", "", ["The entry's time was changed later.", "The sender cannot be confirmed.", "Parts of the note are missing."]))
    out.append(("qualifier", "", [" as far as can be seen", " on a second viewing", " in poor light", " at a distance"]))
    return out


def descriptions(domain: str, template: str) -> list[str]:
    """Twelve report texts: four openings, three ends."""
    kind, steps = domain.split("_")[0].lower(), template.replace("_", " then ").lower()
    opened = [f"A case of the {kind} kind", f"Report of {steps}", f"The {kind} desk notes {steps}", "Taken down by the officer on duty"]
    ends = ["{s} suspect(s) and {w} witness(es) are named.", "{s} accused, {w} who saw it.", f"it went {steps}; {{s}} took part and {{w}} looked on."]
    return [f"{o}: {e}" for o in opened for e in ends]


def crime_types(domain: str) -> list[str]:
    return {"ATM_Robbery": ["cash machine robbery", "card fraud at a machine"], "Office_Theft": ["theft from an office", "theft of data"], "Communication": ["planning by phone", "threats by message"]}[domain]


# ---- as DataFrames ---------------------------------------------------------------------------------------------------------------


def dim_template(spark: SparkSession) -> DataFrame:
    per = {d: [t for e, t in SLOTS if e == d] for d in WINDOWS}
    rows = [(i, d, j, len(per[d]), t, *WINDOWS[d], crime_types(d), descriptions(d, t), [p for m in SOURCES for p in PLACES[d, m]]) for i, d in enumerate(WINDOWS) for j, t in enumerate(per[d])]
    return spark.createDataFrame(rows, "domain_no INT, domain STRING, template_no INT, n_templates INT, template STRING, window_min INT, window_max INT, crime_types ARRAY<STRING>, descriptions ARRAY<STRING>, locations ARRAY<STRING>")


def dim_slot(spark: SparkSession) -> DataFrame:
    rows = [(d, t, i, *s) for (d, t), slots in SLOTS.items() for i, s in enumerate(slots)]
    return spark.createDataFrame(rows, "domain STRING, template STRING, slot_ord INT, slot_id STRING, role STRING, role_index INT, action STRING, required BOOLEAN, min_delta INT, max_delta INT")


def dim_source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, s) for m, s in SOURCES.items()], "modality STRING, sources ARRAY<STRING>")


def dim_location(spark: SparkSession) -> DataFrame:
    rows = [(d, m, s, p) for (d, m), places in PLACES.items() for s, p in zip(SOURCES[m], places, strict=True)]
    return spark.createDataFrame(rows, "domain STRING, modality STRING, source STRING, location STRING")


def dim_weight(spark: SparkSession) -> DataFrame:
    rows = [(r, m, p, *CONFIDENCE.get((r, m), (0.50, 0.80))) for (r, m), p in WEIGHTS.items()]
    return spark.createDataFrame(rows, "role STRING, modality STRING, p DOUBLE, conf_lo DOUBLE, conf_hi DOUBLE")


def dim_phrase(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(phrases(), "kind STRING, action STRING, pool ARRAY<STRING>")
