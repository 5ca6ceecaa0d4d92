"""Rule profiles.

The log analyser exists in three variants that disagree in details (where the ignore list is tested,
how comments are cut, how the first word is read, how patterns are normalised). A ``Profile`` names
the variant; the functions below it take the profile and pick the matching column expression.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """Which rule variant to apply.

    word_match      how an opening word is recognised: ``prefix`` or ``whole`` word
    bare_load       whether ``LOAD`` on its own is a write category
    loose_phrases   whether phrases allow any run of white space between words
    ignore_raw      ignore list tested on the statement before the comment is cut
    ignore_cleaned  ignore list tested on the statement after the comment is cut
    truncate_stats  averages and shares cut to fixed decimals instead of kept as they are
    """

    name: str
    word_match: str
    bare_load: bool
    loose_phrases: bool
    ignore_raw: bool
    ignore_cleaned: bool
    truncate_stats: bool


PYTHON = Profile("P", "prefix", False, False, True, True, False)
AWK = Profile("A", "whole", True, False, False, True, True)
SHELL = Profile("E", "prefix", False, True, True, False, False)

PROFILES = {p.name: p for p in (PYTHON, AWK, SHELL)}
