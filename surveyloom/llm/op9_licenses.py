"""Fuzzy short-notice search for licence notices.

Notices are short word sequences. A notice that stands in a text with at most k edits
holds at least one of k + 1 pieces of it unchanged, so exact search for the pieces finds
every candidate; around each, bounded-error matching of the ``regex`` library verifies
the edits and gives the span. The words that tell one licence from its neighbours, such as
its version, must stand in the span unchanged. Each text is judged alone, in the task that
reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import LOWER, blocks

#: Phrases that are found exactly, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that are found with edits, with the labels of the method; a word after ``=`` must stand unchanged.
NOTICES = {
    "under the =gnu =general public license version =1": "gpl-1",
    "under the =gnu =general public license version =2": "gpl-2",
    "under the =gnu =general public license version =3": "gpl-3",
    "under the terms of the =gnu =general public license": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the =gnu =general public license": "gpl",
    "under the =gnu =lesser general public license version =2 =1": "lgpl-2.1",
    "under the =gnu =lesser general public license version =3": "lgpl-3",
    "under the terms of the =gnu =lesser general public license": "lgpl",
    "under the =gnu =affero general public license version =3": "agpl-3",
    "under the terms of the =gnu =affero general public license": "agpl",
    "under the =gnu =free documentation license": "gfdl",
    "under the =apache license version =1 =1": "apache-1.1",
    "under the =apache license version =2 =0": "apache-2.0",
    "released under the =mit license": "mit",
    "licensed under the =mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "under the =bsd =2 clause license": "bsd-2",
    "under the =bsd =3 clause license": "bsd-3",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "subject to the terms of the =mozilla public license v =1 =1": "mpl-1.1",
    "subject to the terms of the =mozilla public license v =2 =0": "mpl-2.0",
    "this source code form is subject to the terms of the =mozilla public license": "mpl",
    "under the terms of the =eclipse public license v =1 =0": "epl-1.0",
    "under the terms of the =eclipse public license v =2 =0": "epl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the =boost software license version =1 =0": "bsl-1.0",
    "under the =artistic license =2 =0": "artistic-2.0",
    "this work is licensed under a =creative =commons =zero license": "cc0",
    "licensed under a =creative =commons =attribution": "cc-by",
    "all rights reserved": "reserved",
}
#: The variants of one licence family differ in these words alone, so their notices follow from a rule.
NOTICES |= {
    f"licensed under =cc =by {''.join(f'={x} ' for x in variant)}={version} =0": "-".join(("cc-by", *variant))
    for version in (2, 3, 4)
    for variant in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd"))
}
#: Names without a lead-in, which carry a version or a variant themselves. Fixed values.
NAMES = {
    "=gnu =general public license version =1": "gpl-1",
    "=gnu =general public license version =2": "gpl-2",
    "=gnu =general public license version =3": "gpl-3",
    "=gnu =lesser general public license version =2 =1": "lgpl-2.1",
    "=gnu =lesser general public license version =3": "lgpl-3",
    "=gnu =affero general public license version =3": "agpl-3",
    "=apache license =1 =1": "apache-1.1",
    "=apache license =2 =0": "apache-2.0",
    "=apache license version =1 =1": "apache-1.1",
    "=apache license version =2 =0": "apache-2.0",
    "=bsd =2 clause license": "bsd-2",
    "=bsd =3 clause license": "bsd-3",
    "=mozilla public license =1 =1": "mpl-1.1",
    "=mozilla public license =2 =0": "mpl-2.0",
    "=mozilla public license version =2 =0": "mpl-2.0",
    "=eclipse public license =1 =0": "epl-1.0",
    "=eclipse public license =2 =0": "epl-2.0",
}
NAMES |= {w.removeprefix("licensed under "): label for w, label in NOTICES.items() if w.startswith("licensed under =cc ")}
#: What stands after a licence identifier of a file's head, with its label. Fixed values.
IDENTIFIERS = {
    "=mit": "mit", "=isc": "isc", "=unlicense": "unlicense", "=apache =2 =0": "apache-2.0", "=bsd =2 =clause": "bsd-2", "=bsd =3 =clause": "bsd-3",
    "=gpl =2 =0": "gpl-2", "=gpl =3 =0": "gpl-3", "=lgpl =2 =1": "lgpl-2.1", "=lgpl =3 =0": "lgpl-3", "=agpl =3 =0": "agpl-3",
    "=mpl =2 =0": "mpl-2.0", "=epl =2 =0": "epl-2.0", "=bsl =1 =0": "bsl-1.0", "=cc0 =1 =0": "cc0", "=cc =by =4 =0": "cc-by", "=cc =by =sa =4 =0": "cc-by-sa",
}
NAMES |= {f"spdx license identifier {w}": label for w, label in IDENTIFIERS.items()}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: long, length: long, edits: long>>"
)
#: Everything but digits, a-z (after lowering) and bytes of longer characters ends a word.
_KEEP = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TABLE = bytes(b if b in _KEEP else 0x20 for b in LOWER.tolist())


class Notice:
    """One notice with its pieces, its bounded-error pattern and the words that must stand unchanged."""

    def __init__(self, words: str, label: str, edits_per: int):
        self.exact = [x[1:].encode() for x in words.split() if x[0] == "="]
        self.words, self.label = words.replace("=", "").encode(), label
        self.edits = max(1, len(self.words) // edits_per)
        cuts = np.linspace(0, len(self.words), self.edits + 2).round().astype(int)
        self.pieces = [(int(a), self.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rb"(?b)\b(?:" + regex.escape(self.words, literal_spaces=True) + rb"){e<=%d}\b" % self.edits)

    def agrees(self, span: bytes) -> bool:
        """Whether the words that must stand unchanged do, in their order."""
        words = iter(span.split())
        return all(x in words for x in self.exact)

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """Byte spans and edits of all matches in a normalised text, without overlaps."""
        places = []
        for shift, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                places.append(at - shift)
                at = text.find(piece, at + 1)
        areas: list[list[int]] = []
        size = len(self.words) + 2 * self.edits
        for at in sorted(places):
            # a word's end is seen only with the byte after it
            low, high = max(0, at - self.edits - 1), at + size + 1
            if areas and low <= areas[-1][1]:
                areas[-1][1] = max(areas[-1][1], high)
            else:
                areas.append([low, high])
        found = []
        for low, high in areas:
            while m := self.pattern.search(text, low, min(high, len(text))):
                if self.agrees(m[0]):
                    found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                    low = max(m.end(), low + 1)
                else:  # another notice of the family; a later start may still be this one
                    low = m.start() + 1
        return found


def scan(text: str | None, notices: list[Notice]) -> tuple:
    """The row of ``SCHEMA`` (without its id) for one text."""
    words = (text or "").encode().translate(_TABLE).split()
    flat = b" " + b" ".join(words) + b" "
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    word_at = lambda at: int(np.searchsorted(gaps, at))  # noqa: E731  words that end before this byte
    places, base = [], set()
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at = flat.find(needle)
        while at >= 0:
            places.append(word_at(at))
            base.add(label)
            at = flat.find(needle, at + 1)
    spans = []
    for notice in notices:
        for a, b, edits in notice.spans(flat):
            spans.append((notice.label, word_at(a + 1) - 1, len(flat[a:b].split()), edits, len(notice.words)))
    labels = base | {x[0] for x in spans}
    best = max([0.0, *([1.0] if base else []), *(1 - e / n for *_, e, n in spans)])
    names = ["label", "start", "length", "edits"]
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), best, [dict(zip(names, x[:4], strict=True)) for x in sorted(spans, key=lambda x: (x[1], x[0]))],
    )


def scan_licenses(df: DataFrame, *, edits_per: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``SCHEMA`` per row of ``df``; notices may differ by one edit per ``edits_per`` characters.

    ``n_base`` counts all places of the base phrases, ``labels`` holds base labels and those of the
    notices, ``spans`` their places in words (ties in the order of the label), ``score`` the best
    agreement. Null and empty texts have no words, no labels and score 0; repeated rows are scanned
    alike; other columns are ignored.
    """
    names = [x.split()[0] for x in SCHEMA.split(", spans")[0].split(", ")] + ["spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("edits", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = [Notice(w, label, edits_per) for w, label in (NOTICES | NAMES).items()]
        for batch in batches:
            for part in blocks(batch):
                cols = list(zip(*(scan(t, notices) for t in part.column(1).to_pylist()), strict=True))
                cols = cols or [()] * 8
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names=names)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCHEMA)
