"""Phrase matching with Spark's own regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.model import Phrase

#: A word character is a letter, a number or an underscore in any script.
WORD = r"[\p{L}\p{N}_]"
_FLAGS = "(?iu)"
MODES = ("word", "substring", "regex")


def quote(text: str) -> str:
    """Escape ``text`` for use inside a Java regular expression."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _body(phrase: Phrase) -> str:
    if phrase.mode == "regex":
        return f"(?:{phrase.text})"
    if phrase.mode == "substring":
        return quote(phrase.text)
    # The text comes first and its left neighbour is looked at afterwards, so that
    # most positions fail on one character.
    body = quote(phrase.text)
    return rf"{body}(?<!{WORD}{body})(?!{WORD})"


def pattern(phrase: Phrase) -> str:
    return _FLAGS + _body(phrase)


def any_pattern(phrases: Sequence[Phrase]) -> str:
    """One pattern that matches wherever at least one phrase does."""
    return _FLAGS + "|".join(_body(p) for p in phrases)


def coerce_phrases(entries: Iterable[Any]) -> tuple[list[Phrase], list[dict[str, Any]]]:
    """Turn strings and mappings into phrases; return the rejects with a reason."""
    kept: list[Phrase] = []
    dropped: list[dict[str, Any]] = []
    for entry in entries:
        if isinstance(entry, Phrase):
            kept.append(entry)
        elif isinstance(entry, str):
            kept.append(Phrase(entry))
        elif isinstance(entry, dict) and isinstance(entry.get("text"), str):
            mode, intent = entry.get("mode", "word"), entry.get("intent")
            kept.append(
                Phrase(
                    entry["text"],
                    str(entry.get("category", "custom")),
                    intent if isinstance(intent, str) else None,
                    mode if mode in MODES else "word",
                )
            )
        elif isinstance(entry, dict):
            dropped.append({"reason": "no text", "entry": ",".join(sorted(map(str, entry)))})
        else:
            dropped.append({"reason": "unsupported type", "entry": type(entry).__name__})
    return kept, dropped


def hit_counts(text: Column, phrases: Sequence[Phrase]) -> Column:
    """array<int>: occurrences of each phrase, null where no phrase occurs at all.

    Most texts hold no phrase, so a single alternation decides first and the
    per-phrase counts are only taken on the texts that pass.
    """
    return F.when(
        text.rlike(any_pattern(phrases)),
        F.array(*[F.regexp_count(text, F.lit(pattern(p))) for p in phrases]),
    )


def hit_total(counts: Column) -> Column:
    return F.coalesce(F.aggregate(counts, F.lit(0), lambda a, b: a + b), F.lit(0))


def hit_spans(text: Column, phrase: Phrase) -> Column:
    """array<struct<start,end,matched>> of the non-overlapping hits of one phrase.

    Starts are rebuilt from the text between the hits: the n-th hit begins after
    the first n gaps and the first n-1 hits.  Offsets count characters.
    """
    regex = pattern(phrase)
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.transform(F.split(text, regex, -1), lambda part: F.length(part))
    spans = F.aggregate(
        F.arrays_zip(found.alias("m"), gaps.alias("g")),
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,end:int,matched:string>>").alias("hits"),
        ),
        lambda acc, item: F.struct(
            (acc["at"] + item["g"] + F.coalesce(F.length(item["m"]), F.lit(0))).alias("at"),
            F.when(item["m"].isNull(), acc["hits"])
            .otherwise(
                F.concat(
                    acc["hits"],
                    F.array(
                        F.struct(
                            (acc["at"] + item["g"]).alias("start"),
                            (acc["at"] + item["g"] + F.length(item["m"])).alias("end"),
                            item["m"].alias("matched"),
                        )
                    ),
                )
            )
            .alias("hits"),
        ),
        lambda acc: acc["hits"],
    )
    return spans


def snippet(text: Column, start: Column, end: Column, around: int = 40) -> Column:
    """The matched text with up to ``around`` characters on each side."""
    left = F.greatest(start - around, F.lit(0))
    return F.substring(text, left + 1, F.least(end + around, F.length(text)) - left)


def keyword(words: str) -> str:
    """Pattern for any of the ``|``-separated words, bounded on both sides."""
    return rf"{_FLAGS}(?<!{WORD})(?:{words})(?!{WORD})"
