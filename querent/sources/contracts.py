"""What small JSON documents and parameter sets must hold, as tables of rules.

A rule names a place in a document and a test of what lies there. All documents are held against their
table by one function, which lists every rule that is broken.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from querent.operators.calibration import ABSTAIN_ALWAYS


@dataclass(frozen=True)
class Rule:
    at: str
    wanted: str
    holds: Callable[[Any], bool]


def one_of(*values: object) -> Callable[[Any], bool]:
    """One of these values; True isn't 1."""
    return lambda v: any(type(v) is type(x) and v == x for x in values)


def number(low: float, high: float, whole: bool = False) -> Callable[[Any], bool]:
    """A finite number within bounds; truth values aren't numbers."""
    return lambda v: type(v) in ((int,) if whole else (int, float)) and math.isfinite(v) and low <= v <= high


def text(v: Any) -> bool:
    return isinstance(v, str) and bool(v.strip())


def digest(v: Any) -> bool:
    return isinstance(v, str) and re.fullmatch("[0-9a-f]{64}", v) is not None


def filled(kind: type) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, kind) and bool(v)


_COUNT = number(0, math.inf, whole=True)
RULES: dict[str, tuple[Rule, ...]] = {
    "calibration": (
        Rule("schema_version", "1", one_of(1)),
        Rule("dataset_fingerprint", "a SHA-256", digest),
        Rule("development_fingerprint", "a SHA-256", digest),
        Rule("calibration.split", "dev", one_of("dev")),
        Rule("calibration.threshold", f"a number from 0 to {ABSTAIN_ALWAYS}", number(0, ABSTAIN_ALWAYS)),
    ),
    "manifest": (
        Rule("schema_version", "1 or 2", one_of(1, 2)),
        Rule("corpus", "a SHA-256", digest),
        Rule("encoder", "a SHA-256", digest),
    ),
    "provenance": (
        *(Rule(f, "a text", text) for f in ("kind", "license", "permission")),
        *(Rule(f"counts.{f}", "a count", _COUNT) for f in ("documents", "development_queries", "held_out_queries")),
    ),
    "report": (
        Rule("schema_version", "1", one_of(1)),
        Rule("data_file_sha256", "the files' hashes", filled(object)),
        Rule("latency_protocol", "how latency was taken", filled(object)),
        Rule("models.encoder.fingerprint", "a fingerprint", text),
        Rule("models.reader.fingerprint", "a fingerprint", text),
        Rule("experiments", "experiments by name", filled(dict)),
    ),
}


def lookup(document: Any, at: str) -> Any:
    """What lies at a place of a document; None if the way there is cut off."""
    for step in at.split("."):
        document = document.get(step) if isinstance(document, dict) else None
    return document


def faults(kind: str, document: Any) -> list[str]:
    """The rules of a kind of document that are broken."""
    if not isinstance(document, dict):
        return [f"{kind} isn't an object"]
    return [f"{kind}.{r.at} isn't {r.wanted}" for r in RULES[kind] if not r.holds(lookup(document, r.at))]


def checked(kind: str, document: Any) -> dict:
    """The document; ValueError with all broken rules."""
    if broken := faults(kind, document):
        raise ValueError("; ".join(broken))
    return document


class Parameters:
    """Base of frozen dataclasses whose fields carry their own test: ``field(default, metadata={"holds": ..., "wanted": ...})``."""

    def __post_init__(self) -> None:
        broken = [f"{f.name} isn't {f.metadata['wanted']}" for f in fields(self) if "holds" in f.metadata and not f.metadata["holds"](getattr(self, f.name))]
        if broken:
            raise ValueError("; ".join(broken))


def within(low: int, high: int, default: int) -> dict:
    """Arguments of ``field`` for a whole number within bounds."""
    return {"default": default, "metadata": {"holds": number(low, high, whole=True), "wanted": f"a whole number from {low} to {high}"}}
