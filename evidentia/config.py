"""Settings of the resolver."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class ErConfig:
    """Thresholds and switches; the defaults are fixed values that right results depend on."""

    check_duplicates: bool = True
    case_base_time: str | None = None  # only echoed
    temporal_window_sec: int = 300
    max_temporal_gap_sec: int = 3600
    max_pairs: int | None = 500  # None: no cap
    confirmed_threshold: float = 0.80
    candidate_threshold_low: float = 0.50
    candidate_threshold_high: float = 0.65
    attachment_threshold: float = 0.70
    cluster_confidence_floor: float = 0.55
    cross_modal_merge_min: float = 0.58
    merge_composite_min: float = 0.55
    oversized_cluster_factor: float = 3.0
    double_penalty: bool = True  # the conflict penalty counts twice when no scorer is plugged in

    def echo(self) -> dict:
        names = ("check_duplicates", "case_base_time", "temporal_window_sec", "max_temporal_gap_sec", "max_pairs", "confirmed_threshold", "candidate_threshold_low", "candidate_threshold_high", "cross_modal_merge_min", "merge_composite_min")
        return {k: v for k, v in asdict(self).items() if k in names}


# Fixed values that scores depend on.
FEATURES = ("entity_coreference", "mention_consistency", "temporal", "location", "context", "lexical", "interaction", "modality")
WEIGHTS = {"entity_coreference": 0.280, "mention_consistency": 0.120, "temporal": 0.150, "location": 0.100, "context": 0.180, "lexical": 0.050, "interaction": 0.070, "modality": 0.050}
ACTIONS = ["enter", "exit", "withdraw", "deposit", "call", "message", "send", "receive", "transfer", "arrive", "depart", "access", "attempt", "fail", "succeed", "heading", "headed", "inside", "clear"]
OPPOSITES = [("enter", "exit"), ("withdraw", "deposit"), ("arrive", "depart"), ("send", "receive"), ("succeed", "fail"), ("heading", "exited")]
TOPICAL = ["enter", "entered", "inside", "heading", "headed", "starting", "exit", "exited", "coming", "leaving", "depart", "server", "ssh", "login", "access", "atm", "booth", "clear"]
PLACES = ["atm", "server", "booth", "room", "network", "ssh", "login"]
ENTERING = ["enter", "entered", "inside", "heading", "headed", "starting"]
EXITING = ["exit", "exited", "coming", "leaving", "depart"]
APPROACHING = ["heading", "headed", "towards", "see", "activity"]
MODALITY_PAIRS = {("audio", "video"): 0.85, ("text", "video"): 0.72, ("audio", "text"): 0.68, ("video", "video"): 0.50, ("audio", "audio"): 0.50, ("text", "text"): 0.45}
OPPOSED_ROLES = [("suspect", "witness"), ("suspect", "victim"), ("perpetrator", "victim")]
