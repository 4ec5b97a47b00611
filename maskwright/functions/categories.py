"""Categories of identifiers, sources of detections and their standing in a merge."""

from __future__ import annotations

#: Fixed values, in ordinal order.
CATEGORIES = "NAME ADDRESS LOCATION ZIP DATE AGE PHONE FAX EMAIL SSN MRN PLAN ACCOUNT LICENSE VEHICLE DEVICE URL IP BIOMETRIC ID ORG".split()
#: What a source adds to a span's confidence when overlapping spans compete.
BONUS = {"manual": 3.0, "rule": 1.0, "model": 0.5, "propagated": 0.0}

SPAN = "struct<start: int, end: int, category: string, source: string, confidence: double, dob: boolean>"
SPANS = f"array<{SPAN}>"
