"""Counts of many lexicon words in one pass over a text.

One pattern, a tree of the lexicon's letters, finds the longest word at each place of a text; the shorter words there are
its beginnings and are looked up in hashed sets. A place is left at the first letter that no word has, so the work follows
the length of the text and not the number of words. Occurrences of one word do
not overlap, from the left, as with a replacement of the word; occurrences of different words may. A word that can
overlap itself ("aa", "aba") is counted by replacement instead; there are few in a lexicon.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticktote.functions.text import occurrences


def overlaps_itself(word: str) -> bool:
    """Whether an end of the word is a beginning of it."""
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def _trie(words: Iterable[str]) -> str:
    """Pattern of the longest of the words at a place; words with a common beginning share it, so a place is left at its first other letter."""
    root: dict = {}
    for w in words:
        node = root
        for letter in w:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        # the end of a word comes last, so that longer words are tried before it
        parts = [(letter if letter.isalnum() else "\\" + letter) + pattern(node[letter]) for letter in sorted(k for k in node if k)]
        parts += [""] if "" in node else []
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(root)


def lexicon_hits(text: Column, words: Iterable[str]) -> Column:
    """array<string>: the word of every occurrence at every place, shorter words first; a null or empty text has none."""
    by_size: dict[int, list[str]] = defaultdict(list)
    for w in sorted(set(words)):
        if not w:
            raise ValueError("the empty word occurs everywhere")
        by_size[len(w)].append(w)
    none = F.array().cast("array<string>")
    if not by_size:
        return none
    longest = F.coalesce(F.regexp_extract_all(text, F.lit(f"(?=({_trie(words)}))"), F.lit(1)), none)

    def of_size(n: int, found: Column) -> Column:
        return F.filter(F.transform(found, lambda w: F.left(w, F.lit(n))), lambda w: w.isin(by_size[n]))

    # searched once for each text; all words at a place are beginnings of the longest one there
    return F.flatten(F.transform(F.array(longest), lambda found: F.concat(none, *[of_size(n, found) for n in sorted(by_size)])))


def counts_by_value(text: Column, hits: Column, values: dict[str, float]) -> dict[float, Column]:
    """value -> number of occurrences of its words. hits: lexicon_hits of text for words that include those of values.

    Words of one value share one lookup. A null text has no occurrence.
    """
    groups: dict[float, list[str]] = defaultdict(list)
    for w, v in values.items():
        groups[float(v)].append(w)

    def number(words: list[str]) -> Column:
        plain = [w for w in words if not overlaps_itself(w)]
        n = F.size(F.filter(hits, lambda e: e.isin(plain))) if plain else F.lit(0)
        return n + sum((F.coalesce(occurrences(text, w), F.lit(0)) for w in words if overlaps_itself(w)), F.lit(0))

    return {v: number(ws) for v, ws in groups.items()}
