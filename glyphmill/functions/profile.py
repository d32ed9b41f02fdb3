"""Script profiles: which characters are the target of segmentation, of the ratio filter, and pauses."""

from __future__ import annotations

from dataclasses import dataclass

# Labels of segments, the ignored target, the pause marks.
PAUSE, TARGET, OTHER = 0, 1, 2
IGNORE = -100
PAUSES = "!?。\n:;,"


@dataclass(frozen=True)
class Profile:
    """Regex classes (without brackets). ``target`` and ``ratio`` may differ: membership in a vocabulary and a range of code points."""

    target: str
    ratio: str
    pause: str = PAUSES


LATIN = Profile("A-Za-zÀ-ÖØ-öø-ÿ", "A-Za-zÀ-ÖØ-öø-ÿ")
HAN_RANGE = "一-鿿"


def han(vocabulary: list[str] | None = None) -> Profile:
    """Han script: target characters are those of the vocabulary, the ratio counts U+4E00 to U+9FFF."""
    if not vocabulary:
        return Profile(HAN_RANGE, HAN_RANGE)
    return Profile("".join(f"\\x{{{ord(c):X}}}" for c in vocabulary if len(c) == 1 and c not in PAUSES), HAN_RANGE)
