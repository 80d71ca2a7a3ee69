"""Schemas of cases and observations."""

OBSERVATION = "obs_id STRING, entity STRING, role STRING, modality STRING, location STRING, content STRING, timestamp STRING, confidence STRING"
#: A case document as it is read: everything but the structure is coerced later, so a bad value costs its row, not the file.
CASE = f"case_id STRING, observations ARRAY<STRUCT<{', '.join(f.replace(' ', ': ') for f in OBSERVATION.split(', '))}>>"
RAW = f"case_id STRING, ord BIGINT, {OBSERVATION}"
CONSTRAINT = "case_id STRING, alias_a STRING, alias_b STRING"
HINT = "case_id STRING, alias_lo STRING, alias_hi STRING, hint DOUBLE"
