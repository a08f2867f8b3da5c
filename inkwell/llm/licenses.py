"""Licence scans with a positional rare-token index.

The index is built once from fixed templates: for every word the places (template, position) where it stands, and the key phrases
that a finding must show. A word's weight is its inverse document frequency over the whole scanned table (a
count of the templates' words only, a few hundred rows). Each template is looked up by its own places of the highest weight, LEAST_VOTES more
than a finding may miss, so that every finding has enough votes whatever else the text holds. Their
postings are intersected by relative position, that is, each occurrence votes for (template, place of its first
word), and a place with enough votes is verified: the share of the template's words that stand where they should, and all mandatory
phrases within its span.

Base labels come from three phrases wherever their words stand consecutively; findings of the index only add labels.

Defined cases: null text is empty (no words, no label, score 0); ties between words of one weight go by the word; rows that repeat are
scanned each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, text_bytes

# Phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Usual notices and the sentences of public licences' texts that are the licence's own, with the phrases each must show. A text is found by its sentences, so
# names, dates and other insertions between them don't matter.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["permission is hereby granted", "free of charge"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ["apache license", "in compliance with"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["free software", "general public license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("agpl", "Licensed under the GNU Affero General Public License", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms", "conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["public domain", "unencumbered software"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ["permission is hereby granted", "merge publish distribute sublicense"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ["this permission notice shall be included"]),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ["as is basis", "warranties or conditions"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistributions of source code"]),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ["redistributions in binary form"]),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", ["see the gnu general public license"]),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program", ["copy of the gnu general public license"]),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library", ["gnu lesser general public license"]),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program", ["gnu affero general public license"]),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at", ["copy of the mpl"]),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", ["anyone is free to copy modify publish"]),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ["alter it and redistribute it freely"]),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ["person or organization obtaining a copy"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ["sil open font license"]),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", ["without a written agreement"]),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ["changing it is allowed"]),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["dedicated the work to the public domain"]),
]
#: Share of a template's words that must stand in place, and number of its looked-up words that must have voted.
LEAST_SHARE = 0.85
LEAST_VOTES = 2

#: Separators become blanks and A-Z become a-z, so that split() gives the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class LicenceIndex:
    def __init__(self, templates=TEMPLATES):
        self.templates = [(label, words_of(t.encode()), [words_of(p.encode()) for p in phrases]) for label, t, phrases in templates]
        self.vocabulary = list(dict.fromkeys(w for _, words, _ in self.templates for w in words))
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.weighted({}, 0)

    def weighted(self, frequency: dict[bytes, int], documents: int) -> LicenceIndex:
        weight = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in self.vocabulary}
        self.postings = defaultdict(list)
        for i, (_, words, _) in enumerate(self.templates):
            missing = sum(k / len(words) >= LEAST_SHARE for k in range(len(words)))
            for at in sorted(range(len(words)), key=lambda p: (-weight[words[p]], words[p], p))[: missing + LEAST_VOTES]:
                self.postings[words[at]].append((i, at))
        return self

    def scan(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, share of the template in place) of all verified findings."""
        votes: Counter[tuple[int, int]] = Counter()
        for w in self.postings.keys() & set(words):
            at = -1
            try:
                while True:
                    at = words.index(w, at + 1)
                    votes.update((t, at - p) for t, p in self.postings[w])
            except ValueError:
                pass
        found = []
        for (t, first), n in votes.items():
            label, template, phrases = self.templates[t]
            if n < min(LEAST_VOTES, len(template)) or first < -len(template):
                continue
            span = words[max(first, 0) : first + len(template)]
            shift = max(-first, 0)
            share = sum(a == b for a, b in zip(span, template[shift:])) / len(template)
            if share >= LEAST_SHARE and all(places(span, p) for p in phrases):
                found.append((label, share))
        return found


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively; the last word is searched for, being the rarest here."""
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[-1], at + 1)
            if at + 1 >= n and words[at + 1 - n : at + 1] == phrase:
                out.append(at + 1 - n)
    except ValueError:
        return out


def frequencies(docs: DataFrame, vocabulary: list[bytes]) -> tuple[dict[bytes, int], int]:
    """Document frequency of the vocabulary's words over all rows, and the number of rows; a task sends one row a word."""
    wanted = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            n[b""] += len(b)
            for t in text_bytes(b["text"]):
                n.update(wanted.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    got = {bytes(r["word"]): r["n"] for r in docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # at most the vocabulary
    return got, got.pop(b"", 0)


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to word count, base places and labels, all labels, and the best finding's share as score."""
    index = LicenceIndex()
    index.weighted(*frequencies(docs, index.vocabulary))
    base = [(words_of(p.encode()), label) for p, label in BASE.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"].to_pylist(), text_bytes(b["text"]), strict=True):
                words = words_of(text)
                at, own = [], set()
                for phrase, label in base:
                    if got := places(words, phrase):
                        at += got
                        own.add(label)
                found = index.scan(words)
                labels = own | {label for label, _ in found}
                score = max([1.0 * bool(own), *(s for _, s in found)])
                rows.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(load(spark, sf_dir, "documents").select("doc_id", "text"))
