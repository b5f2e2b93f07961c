"""Settings of the engine in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field

from .models import Models


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and models; ``replace`` gives variants."""

    models: Models = field(default_factory=Models)
    #: An event type's least probability; a location's least score and overlap; agents' least cosine in full and short texts.
    class_threshold: float = 0.6
    location_score: float = 0.85
    location_overlap: float = 0.5
    agent_least: float = 0.6
    short_agent_least: float = 0.5
    #: Search hits that a query may have, and options that a ranker sees.
    search_hits: int = 200
    options: int = 50
    #: Whether country words must begin at a word's start; without it "USS" holds the pattern "U.S".
    strict_demonyms: bool = False
    #: Folder for stages and their run's name; none: stages stay lazy.
    stages: str | None = None
    run: str = "run"
