"""Names and types shared by the graph operators."""

from __future__ import annotations

AMBIGUOUS, INFERRED, EXTRACTED = 0, 1, 2
CONFIDENCE = {"ambiguous": AMBIGUOUS, "inferred": INFERRED, "extracted": EXTRACTED}
CALL, RESOLVES_TO = 0, 1

NODES = "node long, symbol string, file string, name string, is_defined boolean"
EDGES = "src long, dst long, ts long, authority double, edge_kind int, confidence int, seq long"


def confidence_floor(label: str | int | None) -> int:
    """The rank of a confidence; an unknown label is an error."""
    if label is None:
        return AMBIGUOUS
    if isinstance(label, int) and label in CONFIDENCE.values():
        return label
    if label not in CONFIDENCE:
        raise ValueError(f"unknown confidence {label!r}: one of {', '.join(CONFIDENCE)}")
    return CONFIDENCE[label]
