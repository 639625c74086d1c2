"""Stopword lists by language code."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import cache
from pathlib import Path

_NAMES = {"english": "en", "english_plus": "en_plus", "german": "de", "dutch": "nl", "french": "fr", "spanish": "es", "portuguese": "pt", "italian": "it", "russian": "ru", "swedish": "sv", "norwegian": "no", "chinese": "zh", "turkish": "tr", "korean": "ko"}


@cache
def _lists() -> dict[str, list[str]]:
    return json.loads(Path(__file__).with_name("stopwords.json").read_text(encoding="utf-8"))


def languages() -> list[str]:
    return sorted(_lists())


def stopword_list(which: str | bool | Sequence[str] | None) -> list[str]:
    """A language's list ("en", "english", True: the short English one), none, or the given words."""
    if which is None or which is False:
        return []
    if which is True:
        which = "en"
    if isinstance(which, str):
        code = _NAMES.get(which.lower(), which.lower())
        if code not in _lists():
            raise ValueError(f"no stopword list {which!r}; there are {', '.join(languages())}")
        return list(_lists()[code])
    return list(which)
