"""License scans: fuzzy search for short notices from exact seeds."""

from __future__ import annotations

import bisect
import functools
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import table

NOTICES = {
    "mit": "released under the mit license",
    "apache-2.0": "licensed under the apache license, version 2.0",
    "cc-by-nc-4.0": "licensed under cc by-nc 4.0",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-sa-4.0": "licensed under cc by-sa 4.0",
    "gpl-3.0": "licensed under the gnu general public license, version 3",
    "gpl-2.0": "licensed under the gnu general public license, version 2",
    "mpl-2.0": "subject to the terms of the mozilla public license, v. 2.0",
    "bsd": "redistribution and use in source and binary forms, with or without modification, are permitted",
    "all-rights-reserved": "all rights reserved",
}
ERROR_RATE = 0.08


def allowed(notice: str, error_rate: float = ERROR_RATE) -> int:
    """The edits (insertions, deletions, substitutions of characters) that a notice may have."""
    return int(len(notice) * error_rate)


class Scanner:
    def __init__(self, notices: Mapping[str, str], error_rate: float):
        import ahocorasick

        self.notices = [(k, v.lower(), allowed(v, error_rate)) for k, v in notices.items()]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(v, special_only=True)}){{e<={k}}}") for _, v, k in self.notices]
        seeds = defaultdict(list)
        for i, (_, v, k) in enumerate(self.notices):
            cuts = np.linspace(0, len(v), k + 2).astype(int)  # k edits leave one of k + 1 pieces whole
            for a, b in zip(cuts[:-1], cuts[1:]):
                seeds[v[a:b]].append((i, int(a), int(b)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in seeds.items():
            self.automaton.add_word(piece, at)
        self.automaton.make_automaton()

    def scan(self, low: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a lower-cased text."""
        windows: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for last, at in self.automaton.iter(low):
            for i, a, b in at:
                _, v, k = self.notices[i]
                start = last + 1 - b
                windows[i].add((max(0, start - k), min(len(low), start + len(v) + k)))
        found = set()
        for i, spans in windows.items():
            # each window has little more than the notice's length, so the work is that of the seeds
            least, todo = len(self.notices[i][1]) - self.notices[i][2], list(spans)
            while todo:
                s, e = todo.pop()
                if e - s >= least and (m := self.patterns[i].search(low, s, e)):
                    found.add((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                    todo += [(s, m.start()), (m.end(), e)]
        # where notices overlap, the one with fewer edits, then the longer, then the earlier holds
        starts: list[int] = []
        kept: list[tuple[int, int, int, int]] = []  # apart from each other, in order
        for f in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[1], x[0])):
            at = bisect.bisect_left(starts, f[1])
            if (not at or kept[at - 1][2] <= f[1]) and (at == len(kept) or kept[at][1] >= f[2]):
                starts.insert(at, f[1])
                kept.insert(at, f)
        return kept


@functools.cache
def _scanner(notices: tuple, error_rate: float) -> Scanner:
    return Scanner(dict(notices), error_rate)


def _scan(batches: Iterator[pa.RecordBatch], notices: tuple, error_rate: float) -> Iterator[pa.RecordBatch]:
    scanner = _scanner(notices, error_rate)
    for whole in batches:
        rows = []
        for b in tx.slices(whole, "text", tx.SLICE):
            cp, off = tx.codepoints(b.column(1))
            low = tx.lowered(cp).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ids, at = b.column(0).to_pylist(), off.tolist()
            for k, doc in enumerate(ids):
                text = low[at[k] : at[k + 1]]
                for i, s, e, edits in scanner.scan(text):
                    as_is = cp[at[k] + s : at[k] + e].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    rows.append((doc, scanner.notices[i][0], s, e, edits, as_is))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))],
                names=["doc_id", "license", "start", "end", "edits", "matched"],
            )


def scan_licenses(docs: DataFrame, notices: Mapping[str, str] = NOTICES, error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, license, start, end (characters, end exclusive), edits, matched: where a text has a notice with at most
    int(error_rate * length) edited characters, letter case apart.

    A notice with k allowed edits is cut in k + 1 pieces, one of which an occurrence must hold unchanged; one automaton
    finds all pieces, and only around them does bounded-error matching look for the best occurrence. One scan of the
    whole texts, no shuffle; the notices are the only thing sent out.

    Occurrences do not overlap: of overlapping ones that with fewer edits is kept, then the longer, then the earlier.
    Null and empty texts have no rows; repeated rows each give theirs; a null doc_id stays null; columns besides doc_id
    and text are ignored; an empty table gives an empty table.
    """
    if any(len(v) < allowed(v, error_rate) + 1 or not v for v in notices.values()):
        raise ValueError("a notice must be longer than its allowed edits")
    fixed = tuple(notices.items())
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _scan(it, fixed, error_rate), "doc_id bigint, license string, start int, end int, edits int, matched string"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
