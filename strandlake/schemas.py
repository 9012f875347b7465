"""Schemas of the tables that are read from text files; nothing is inferred."""

from __future__ import annotations

#: The nine columns of an annotation file.
ANNOTATION = "seqid string, source string, type string, start string, end string, score string, strand string, phase string, attributes string"
INTERVAL = "start long, end long"
POSITION = "position long"
SEQUENCE = "seqid string, seq string"
SEGMENT = "segment string, label string, mask array<int>"
