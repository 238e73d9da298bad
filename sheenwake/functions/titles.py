"""Reading incident titles: hint words and a best-effort vessel name."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# Substrings that point to a vessel, and to oil.
VESSEL_HINTS = [
    "vessel", "ship", "barge", "tanker", "tug", "boat", "freighter", "trawler",
    "fishing", "cargo", "ferry", "yacht", "sunken", "sank", "sinking", "capsiz",
    "grounding", "aground", "collision", "allision", "t/v", "m/v", "f/v", "s/s",
]
OIL_HINTS = [
    "oil", "diesel", "fuel", "crude", "bunker", "gasoline", "petrol", "hydraulic",
    "lube", "ifo", "hfo", "slick", "sheen", "petroleum", "condensate",
]

# Words that are never a vessel name.
STOP_WORDS = [
    "OIL", "SPILL", "BARGE", "TANKER", "VESSEL", "SHIP", "TUG", "BOAT", "FISHING",
    "RIVER", "BAY", "PORT", "HARBOR", "HARBOUR", "CREEK", "LAKE", "ISLAND",
    "MYSTERY", "UNKNOWN", "PIPELINE", "PLATFORM", "TERMINAL", "REFINERY",
]

# The patterns of a prefixed name, of the part before a separator, of a
# word of a name, and of a hull number or roman numeral.
PREFIXED = (r"\b(?:M/V|MV|T/V|TV|F/V|FV|S/S|SS|M/T|MT|USCGC|USNS|R/V)[\s.]+"
            r"([A-Z][A-Za-z0-9'\-]*(?:\s+[A-Z][A-Za-z0-9'\-]*){0,3})")
SEPARATOR = r"[,:;()\-]| spill| incident| release"
NAME_TOKEN = (r"\b[A-Z][A-Z0-9'\-]{2,}\b|\b\d{1,4}\b"
              r"|\b(?:I{1,3}|IV|VI{0,3}|IX|XI{0,2})\b")
NUMERAL = r"^(?:\d{1,4}|I{1,3}|IV|VI{0,3}|IX|XI{0,2})$"


def mentions(text, hints: list[str]) -> Column:
    """True when any hint is a substring of the lower-cased text."""
    return F.lower(col(text)).rlike("|".join(re.escape(h) for h in hints))


def vessel_name(title) -> Column:
    """Name after a prefix, else the capital-letter run before a separator; null if unsure."""
    title = col(title)
    pre = F.trim(F.regexp_extract(title, PREFIXED, 1))
    pre = F.regexp_replace(pre, r"^[ ,.\-]+|[ ,.\-]+$", "")
    pre_ok = (F.length(pre) > 2) & ~F.upper(pre).isin(STOP_WORDS)

    head = F.split(title, SEPARATOR, 2)[0]
    found = F.regexp_extract_all(head, F.lit(f"({NAME_TOKEN})"), 1)
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    tokens = F.filter(found, lambda w: ~F.array_contains(stops, w))
    words = F.filter(tokens, lambda w: ~w.rlike(NUMERAL))
    # Leading numerals fall away: the name starts at the first proper word.
    start = F.array_position(tokens, F.get(words, F.lit(0))).cast("int")
    named = F.slice(tokens, start, F.size(words) + 1)
    guess = F.when(F.size(words).between(1, 3), F.array_join(named, " "))
    return F.when(pre_ok, pre).otherwise(guess)
