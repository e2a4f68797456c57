"""Fuzzy search for short licence notices.

A notice is a run of parts, each with an edit bound of its own; words that decide the licence have
the bound zero.  A part found with at most k edits contains one of its k + 1 pieces unchanged
(pigeonhole), so an automaton over the pieces of each notice's longest part finds every candidate
place exactly.  The regex library's bounded-error matching then verifies the notice around each
candidate and reports its span.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanfold.llm.common import as_bytes, folded_words, in_batches, long_id, merged

#: Exact phrases in folded words, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Notice:
    """Parts in folded words, each found with at most so many character edits, one space between them."""

    label: str
    parts: tuple[tuple[str, int], ...]

    @property
    def text(self) -> str:
        return " ".join(text for text, _ in self.parts)

    @property
    def edits(self) -> int:
        return sum(edits for _, edits in self.parts)


NOTICES = (
    Notice("apache-2.0", (("licensed under the", 3), ("apache", 0), ("license version", 2), ("2 0", 0))),
    Notice("mit", (("released under the", 3), ("mit", 0), ("license", 1))),
    Notice("mit", (("permission is hereby granted free of charge to any person", 5),)),
    Notice("gpl", (("gnu", 0), ("general", 1), ("public license", 2))),
    Notice("lgpl", (("gnu", 0), ("lesser", 0), ("general public license", 3))),
    Notice("bsd", (("redistribution and use in source and binary forms", 4),)),
    Notice("mpl", (("mozilla", 0), ("public license", 2))),
    Notice("cc-by", (("creative commons", 2), ("attribution", 0))),
    Notice("license-notice", (("this work is licensed under", 2),)),
    Notice("reserved", (("all rights reserved", 1),)),
)


class NoticeFinder:
    """Seeds, verification and spans for a fixed list of notices."""

    def __init__(self, notices: Sequence[Notice] = NOTICES):
        self.notices = list(notices)
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, int]]] = {}
        self.verify = []
        for number, notice in enumerate(self.notices):
            if any(len(text) <= edits for text, edits in notice.parts):
                raise ValueError(f"a part of {notice.text!r} is not longer than its edits")
            longest = max(range(len(notice.parts)), key=lambda i: len(notice.parts[i][0]) / (notice.parts[i][1] + 1))
            before = sum(len(text) + 1 for text, _ in notice.parts[:longest])
            (text, edits), slack = notice.parts[longest], sum(k for _, k in notice.parts[: longest + 1])
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            for start, end in zip(cuts, cuts[1:]):
                places.setdefault(text[start:end], []).append((number, before + start, slack))
            found = [regex.escape(t, literal_spaces=True) if not k else f"(?:{regex.escape(t, literal_spaces=True)}){{e<={k}}}" for t, k in notice.parts]
            # A deciding word is a whole one.
            first, last = "" if notice.parts[0][1] else "(?<![^ ])", "" if notice.parts[-1][1] else "(?![^ ])"
            self.verify.append(regex.compile(f"(?e){first}{' '.join(found)}{last}"))
        for seed, uses in places.items():
            self.seeds.add_word(seed, (len(seed), uses))
        if places:
            self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in ``text``: the matches in each run of candidate windows."""
        windows: dict[int, list[tuple[int, int]]] = {}
        if self.notices:
            for last, (size, uses) in self.seeds.iter(text):
                for number, offset, slack in uses:
                    notice = self.notices[number]
                    begin = max(0, last - size + 1 - offset - slack)
                    windows.setdefault(number, []).append((begin, min(len(text), begin + len(notice.text) + 3 * notice.edits)))
        found = set()
        for number, runs in windows.items():
            for begin, end in merged(runs):
                for match in self.verify[number].finditer(text, begin, end):
                    found.add((match.start(), match.end(), number, sum(match.fuzzy_counts)))
        return sorted(found)


def word_starts(words: Sequence[bytes] | Sequence[str]) -> list[int]:
    """Where each word starts when they are joined by spaces."""
    return list(accumulate((len(w) + 1 for w in words), initial=0))[:-1]


def base_places(words: list[bytes], text: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands; ``text`` is the joined words."""
    padded, found = b" " + text + b" ", []
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at = padded.find(needle)
        while at >= 0:
            found.append((at, label))
            at = padded.find(needle, at + 1)
    if not found:
        return []
    starts = word_starts(words)
    return sorted((bisect_right(starts, at) - 1, label) for at, label in found)


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,end_word:long,edits:int,notice:string>>"
)


def _scan(notices: Sequence[Notice]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeFinder(notices)
        fields = pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("notice", pa.string())]))),
        ])
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = folded_words(value.as_py())
                text = b" ".join(words)
                base = base_places(words, text)
                joined = text.decode("utf-8", "replace")
                spans, best = [], 1.0 if base else 0.0
                matches = finder.find(joined)
                starts = word_starts(joined.split(" ")) if matches else []
                for start, end, number, edits in matches:
                    notice = finder.notices[number]
                    best = max(best, 1 - edits / len(notice.text))
                    # A span that begins or ends with an edited space belongs to the words beside it.
                    first, last = bisect_right(starts, start) - 1, bisect_right(starts, max(start, end - 1)) - 1
                    spans.append({"label": notice.label, "first_word": first, "end_word": last + 1, "edits": edits, "notice": notice.text})
                of_base = sorted({label for _, label in base})
                labels = sorted({*of_base, *(s["label"] for s in spans)})
                rows.append({
                    "doc_id": doc_id, "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
                    "base_labels": ",".join(of_base), "labels": ",".join(labels), "score": best, "spans": spans,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return run


def scan_licenses(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row for each row of ``docs``: exact base phrases, fuzzy notices with spans, and a score.

    ``labels`` joins the base labels and the labels of fuzzy matches; ``spans`` has each fuzzy
    match in words, its edits and its notice.  ``score`` is 1 for an exact phrase, else
    1 - edits / length of the best fuzzy match, else 0.  Null and empty texts have no words, null
    first and last words, empty label strings and score 0.  Rows are independent, so repeated ids
    and ties need no rule; other columns are ignored; an empty table gives an empty table.

    A single pass without any shuffle; the notices are a fixed list in the task closure.
    """
    return in_batches(docs.select(long_id(docs), as_bytes("text").alias("text"))).mapInArrow(_scan(tuple(notices)), _SCHEMA)
