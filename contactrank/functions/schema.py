"""Canonical contact fields: aliases, weights and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

#: Header spellings of each field, normalised.
ALIASES = {
    "full": ["fullname"],
    "first": ["firstname"],
    "last": ["lastname"],
    "position": ["position", "title", "role"],
    "company": ["company", "org", "organization", "firm"],
    "email": ["emailaddress", "email"],
    "url": ["url", "profile", "linkedin", "link"],
    "connected_on": ["connectedon", "date"],
}
#: Searched fields in priority order, with the weight of a match.
WEIGHTS = {"full_name": 6, "position": 4, "company": 4, "email": 2, "url": 2, "connected_on": 1, "all_text": 1}
#: Fields that give a reason of their own, with its label.
REASONS = {"full_name": "Name match", "position": "Position match", "company": "Company match", "email": "Email match"}
FALLBACK_REASON = "Matched"
MAX_REASON_TOKENS = 8
MAX_RESULTS = 10
COLUMN_SAMPLE_ROWS = 100
PAGE_SIZES = (25, 50, 100)
DEFAULT_PAGE_SIZE = 50

CELLS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))

FIELDS = [f for f in WEIGHTS if f != "all_text"]
CONTACTS = T.StructType([T.StructField("owner_id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("row_ord", T.LongType()), *(T.StructField(f, T.StringType()) for f in WEIGHTS)])
