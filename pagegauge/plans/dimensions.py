"""Registry of grading dimensions.

A dimension is a name, a column prefix, a weight (see constants), a feature function
``DataFrame -> DataFrame`` and a rule table. Adding one means adding an entry and a weight.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from pagegauge import constants as C
from pagegauge.operators import (
    actionability, agent_signals, content_clarity, machine_readability, performance, structured_data,
)
from pagegauge.operators.rules import Rule


@dataclass(frozen=True)
class Dimension:
    name: str
    prefix: str
    features: Callable[[DataFrame], DataFrame]
    rules: list[Rule]
    scores: tuple[str, ...]
    # True where the features need the origin's site files.
    per_site: bool = field(default=False)

    @property
    def score(self) -> str:
        return f"{self.prefix}_score"

    @property
    def metrics(self) -> str:
        return f"{self.prefix}_metrics"

    @property
    def findings(self) -> str:
        return f"{self.prefix}_findings"


_MODULES = {
    "machineReadability": ("mr", machine_readability),
    "structuredData": ("sd", structured_data),
    "agentSignals": ("as", agent_signals),
    "actionability": ("ac", actionability),
    "performance": ("pf", performance),
    "contentClarity": ("cc", content_clarity),
}
REGISTRY = tuple(
    Dimension(name, _MODULES[name][0], _MODULES[name][1].features, _MODULES[name][1].RULES, _MODULES[name][1].SCORES, name == "agentSignals")
    for name in C.DIMENSIONS
)
