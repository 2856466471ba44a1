"""Line-first cleaning: rules judge lines, and a document falls when too much of its text fails.

A line fails the punctuation rule if symbols, bars or shouting dominate it, or it runs on for many words without any
stop; the navigation rule if separators split it into short labels; the boilerplate rule if it repeats an earlier line
of the document or is a short notice made of stock phrases. Failing lines are removed. A document is kept if its base statistics pass and the
kept lines hold enough of its words.

Defined results: a null text has no words and fails the base. Empty texts too. A null id is kept. Repeated rows are
judged each. An empty table gives an empty table. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from .common import SEPARATORS, arrow_map

#: Stock phrases of notices, in lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "by continuing to browse",
    "click here to",
    "enable javascript",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
)
NOTICE_WORDS = 30
SYMBOLS = re.compile(r"[#*$%&|<>]")
LABEL_BREAK = re.compile(r"[|»›·•>]")
SHOUT = re.compile(r"!{2,}")
STOPS = ".!?…:;\"'”’»)。！？"
#: All bytes but the capital and the small letters of ASCII.
NO_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
NO_SMALL = bytes(b for b in range(256) if not 97 <= b <= 122)
MOST_SYMBOLS = 0.3
MOST_SHOUTS = 0.3
MOST_CAPITALS = 0.7
RUN_ON_WORDS = 400
LEAST_LABELS = 3
LABEL_WORDS = 3
LEAST_KEPT = 0.5

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, kept_words bigint, kept_text string"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) ** 3 >= 2**62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(number) + ids[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def capitals_and_letters(line: str) -> tuple[int, int]:
    """Over the whole line; bytes are counted faster than characters where the line has ASCII only."""
    if line.isascii():
        capitals = len(line.encode().translate(None, NO_CAPITALS))
        return capitals, capitals + len(line.encode().translate(None, NO_SMALL))
    return sum(map(str.isupper, line)), sum(map(str.isalpha, line))


def punctuation_fails(line: str, words: int) -> bool:
    symbols = len(SYMBOLS.findall(line))
    if symbols > MOST_SYMBOLS * words or len(SHOUT.findall(line)) > MOST_SHOUTS * words:
        return True
    capitals, letters = capitals_and_letters(line)
    if letters > 20 and capitals > MOST_CAPITALS * letters:
        return True
    return words > RUN_ON_WORDS and not any(s in line for s in STOPS)


def navigation_fails(line: str, words: int) -> bool:
    labels = [x for x in LABEL_BREAK.split(line) if x.strip()]
    return len(labels) >= LEAST_LABELS and words <= LABEL_WORDS * len(labels)


def boilerplate_fails(line: str, words: int, seen: set[str]) -> bool:
    if line in seen:
        return True
    low = line.lower()
    return words <= NOTICE_WORDS and any(x in low for x in BOILERPLATE)


def judge(text: str | None) -> tuple:
    """Base statistics, verdict, kept words and kept text of one document."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SEPARATORS))
    n_symbols = len(SYMBOLS.findall(text))
    seen: set[str] = set()
    kept_lines, kept_words, duplicates = [], 0, 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            kept_lines.append(line)
            continue
        duplicates += line in seen
        if not (punctuation_fails(line, n) or navigation_fails(line, n) or boilerplate_fails(line, n, seen)):
            kept_lines.append(line)
            kept_words += n
        seen.add(line)
    repeats = repeated_words(words)
    base_failed = n_words < 50 or 100 * repeats > 50 * n_words
    kept = not base_failed and kept_words >= LEAST_KEPT * n_words
    return n_words, word_chars, n_symbols, duplicates, repeats, base_failed, kept, kept_words, "\n".join(kept_lines)


def clean(docs: DataFrame) -> DataFrame:
    """One row per document: statistics, verdict, and the text of the lines that passed."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def rows(batch: dict) -> dict:
        return dict(zip(names, [batch["doc_id"], *zip(*map(judge, batch["text"]))] if batch["text"] else repeat([])))

    return arrow_map(docs.select("doc_id", "text"), rows, SCHEMA)


def verdicts(docs: DataFrame) -> DataFrame:
    return clean(docs).drop("kept_words", "kept_text")
