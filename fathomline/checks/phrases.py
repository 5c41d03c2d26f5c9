"""Phrases with a bound, made from the known words, and what is to be read in them.

``{a}`` is a number of an item and ``{b}`` a larger one. Each case holds the phrase,
its lower and upper bound (``a``, ``b``, ``big`` for what exceeds a bigint, or none), what is left
of it, and its kind.
"""

from __future__ import annotations

from collections.abc import Iterator

from fathomline.functions import constraints as known

Case = tuple[str, str, str, str | None, str | None]
LONG = "{a}" + "9" * 20
UNITS = ("", " ATK", " de ataque")


def _cases() -> Iterator[Case]:
    def one_sided(words, low: str, high: str, kind: str, behind: bool = False) -> Iterator[Case]:
        for i, word in enumerate(words):
            unit = "" if behind else UNITS[i % len(UNITS)]
            yield (f"{{a}} {word}" if behind else f"{word} {{a}}{unit}"), low, high, "", kind

    yield from one_sided(known.MIN_PHRASES, "a", "", "comp_min")
    yield from one_sided(known.MAX_PHRASES + known.MAX_PHRASES_NOT_NEGATED, "", "a", "comp_max")
    yield from one_sided(known.MIN_SUFFIXES, "a", "", "comp_min", behind=True)
    yield from one_sided(known.MAX_SUFFIXES, "", "a", "comp_max", behind=True)
    yield from one_sided(known.MIN_SIGNS, "a", "", "op_min")
    yield from one_sided(known.MAX_SIGNS, "", "a", "op_max")
    yield from one_sided(known.EXACT_WORDS, "a", "a", "eq")
    yield from one_sided(known.KEYWORDS, "a", "a", "eq", behind=True)
    for link in known.EQUALITY_LINKS:
        yield f"atk {link} {{a}}", "a", "a", "", "eq"
    for joint in known.RANGE_SEPARATORS:
        yield f"{{a}} {joint} {{b}} ATK", "a", "b", "", "range"
        for opener in known.RANGE_OPENERS:
            yield f"{opener} {{b}} {joint} {{a}}", "a", "b", "", "range"
    yield f"over {LONG}", "big", "", "", "comp_min"
    yield f"under {LONG} ATK", "", "big", "", "comp_max"
    yield f"between {{a}} and {LONG}", "a", "big", "", "range"
    for vague in known.VAGUE_WORDS:
        yield f"{vague} {{a}} ATK", "", "", None, None
    for free in ("{a}", "floor {a}", "{a}.25 ATK", "rooms {a}-{b}", "atk none"):
        yield free, "", "", None, None


CASES: tuple[Case, ...] = tuple(_cases())
