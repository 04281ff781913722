"""Licence scan of a file tree: sparse TF-IDF cosine to templates, then the
nearest licensed ancestor directory.

Inverse document frequencies of the templates' terms are counted over all texts.
Every window of a text that has a template's length (a *header*) is compared with
it by cosine, terms outside the templates counting as rare ones.  Before a cosine is accepted,
siblings are told apart: the window must hold exactly the ``MARKS`` of its family
(versions, Lesser, Affero, NC, SA, clauses and so on) that the template holds.  The
best remaining template at ``BAR`` or more is the text's own licence; a statement
that names no version of a licence that has several has none.  Long licences are
known by their title and their notice, short ones by their text.  A file named LICENSE,
COPYING, NOTICE or the like (a *licence file*) also licenses its directory.
Files without a licence of their own inherit that of the nearest ancestor
directory: the distinct directories -- not the files -- are joined with the
licensed ones through their ancestors, so a directory that holds most files is
one row until the last join, which has one row for each directory on one side.

Defined results: null and empty texts have no licence of their own; several
licence files of one directory are settled by the higher score, then the smaller
path; a null path inherits nothing; rows that repeat get the same result; extra
columns are ignored; without any match all licences are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.text import PLAIN, Words, chunks, map_arrow, record, stash

BAR = 0.75
_AS_IS = ("THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
          "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS")
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. ")
_ADVERT = ("3. All advertising materials mentioning features or use of this software must display the following "
           "acknowledgement: This product includes software developed by the organization. ")
_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
         "products derived from this software without specific prior written permission. ")
_HOLDERS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
            "ARE DISCLAIMED.")


def _gnu(name: str, title: str, version: str, date: str) -> list[tuple[str, str, str]]:
    notice = "is free software: you can redistribute it and/or modify it under the terms of the GNU"
    return [(name, "gnu", t) for t in (
        f"This work is licensed under the GNU {title}, version {version}.",
        f"This program {notice} {title}, version {version}",
        f"This program {notice} {title} as published by the Free Software Foundation, either version {version} of the License",
        f"GNU {title} Version {version}, {date} Copyright (C) Free Software Foundation, Inc.")]


def _creative(parts: str, version: str) -> list[tuple[str, str, str]]:
    words = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    title = "-".join(words[p] for p in parts.split("-"))
    return [(f"CC-{parts}-{version}", "cc", t) for t in (
        f"Licensed under CC {parts} {version}.",
        f"This work is licensed under a Creative Commons {title} {version} License")]


def _versions(name: str, family: str, title: str, version: str, *more: str) -> list[tuple[str, str, str]]:
    return [(name, family, t) for t in (f"Licensed under the {title}, Version {version}.", *more)]


_KNOWN = [
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "mit", _MIT + ", subject to the following conditions:"),
    ("MIT-0", "mit", _MIT + ". THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"),
    ("BSL-1.0", "mit", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
                       "software and accompanying documentation covered by this license"),
    ("BSL-1.0", "mit", "Distributed under the Boost Software License, Version 1.0."),
    *_versions("Apache-2.0", "version", "Apache License", "2.0", "Apache License Version 2.0, January 2004"),
    *_versions("Apache-1.1", "version", "Apache Software License", "1.1"),
    *_gnu("GPL-3.0", "General Public License", "3", "29 June 2007"),
    *_gnu("GPL-2.0", "General Public License", "2", "June 1991"),
    *_gnu("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"),
    *_gnu("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    *_gnu("LGPL-2.0", "Library General Public License", "2", "June 1991"),
    *_gnu("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
    *[t for v in ("4.0", "3.0") for p in ("BY-NC", "BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND") for t in _creative(p, v)],
    ("CC0-1.0", "cc0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("BSD-2-Clause", "bsd", _BSD + _HOLDERS),
    ("BSD-3-Clause", "bsd", _BSD + "3. " + _NAME + _HOLDERS),
    ("BSD-4-Clause", "bsd", _BSD + _ADVERT + "4. " + _NAME + _HOLDERS),
    *[(f"BSD-{n}-Clause", "bsd", f"Licensed under the BSD {n}-Clause License.") for n in (2, 3, 4)],
    ("ISC", "isc", _FEE + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "isc", "Licensed under the ISC License."),
    ("0BSD", "isc", _FEE + ". " + _AS_IS),
    *_versions("MPL-2.0", "version", "Mozilla Public License", "2.0",
               "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *_versions("MPL-1.1", "version", "Mozilla Public License", "1.1",
               "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    *_versions("EPL-2.0", "version", "Eclipse Public License", "2.0"),
    *_versions("EPL-1.0", "version", "Eclipse Public License", "1.0"),
    ("Unlicense", "", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "", "Released under the Unlicense."),
    ("Zlib", "", "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
                 "held liable for any damages arising from the use of this software."),
]
#: Statements to look for, one or more for each licence.
TEMPLATES = tuple((name, text) for name, _, text in _KNOWN)
#: The words and phrases that tell the licences of a family apart.
MARKS = {
    "mit": ("mit", "boost", "organization", "subject to the following", "is provided as is"),
    "version": ("1", "2", "3", "apache", "mozilla", "eclipse"),
    "gnu": ("lesser", "library general", "affero", "1", "2", "3"),
    "cc": ("nc", "sa", "nd", "noncommercial", "non commercial", "sharealike", "share alike", "noderivatives", "noderivs",
           "no derivatives", "no derivs", "1", "2", "3", "4"),
    "cc0": ("cc0", "waived"),
    "bsd": ("endorse", "all advertising", "2 clause", "3 clause", "4 clause"),
    "isc": ("isc", "provided that", "provided as is"),
}
#: Marks that say the same.
SAME = {"noncommercial": "nc", "non commercial": "nc", "sharealike": "sa", "share alike": "sa", "noderivatives": "nd",
        "noderivs": "nd", "no derivatives": "nd", "no derivs": "nd"}
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"


class Scan:
    """Templates as weighted terms."""

    def __init__(self, templates=TEMPLATES):
        w = Words(pa.record_batch([pa.array([t.encode() for _, t in templates], pa.binary())], names=["text"]), table=PLAIN)
        self.names = [n for n, _ in templates]
        self.terms = np.unique(w.hashes)
        term = np.searchsorted(self.terms, w.hashes)
        self.length = w.lengths
        self.count = np.zeros((len(templates), len(self.terms) + 1))
        np.add.at(self.count, (w.doc, term), 1)
        family = {text: f for _, f, text in _KNOWN}
        phrases = sorted({m for marks in MARKS.values() for m in marks})
        p = Words(pa.record_batch([pa.array([m.encode() for m in phrases], pa.binary())], names=["text"]), table=PLAIN)
        self.phrases = {m: p.hashes[i:i + n] for m, i, n in zip(phrases, p.starts, p.lengths)}
        self.marks = [MARKS.get(family.get(text, ""), ()) for _, text in templates]
        self.own = [self.held(w.hashes[i:i + n], marks) for i, n, marks in zip(w.starts, w.lengths, self.marks)]

    def held(self, words: np.ndarray, marks: tuple[str, ...]) -> set[str]:
        """The marks that a run of words holds."""
        out = set()
        for m in marks:
            at = np.flatnonzero(words[:max(0, len(words) - len(self.phrases[m]) + 1)] == self.phrases[m][0])
            if any((words[i:i + len(self.phrases[m])] == self.phrases[m]).all() for i in at):
                out.add(SAME.get(m, m))
        return out

    def term(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word's term; the last index for all others."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, len(self.terms))

    def best(self, w: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its best template and cosine (-1: none)."""
        rows = len(w.lengths)
        which, score = np.full(rows, -1), np.zeros(rows)
        if not w.total:
            return which, score
        term = self.term(w.hashes)
        weight = idf[term]
        norm = np.r_[0, np.cumsum(weight ** 2)]
        end = (w.starts + w.lengths)[w.doc]
        for t, n in enumerate(self.length):
            goal = self.count[t] * idf
            dot = np.r_[0, np.cumsum(weight * goal[term])]
            stop = np.minimum(np.arange(w.total) + n, end)
            # a window's terms as if distinct: never less than the exact cosine needs to be checked
            rough = (dot[stop] - dot[:-1]) / np.maximum(np.sqrt(norm[stop] - norm[:-1]) * np.linalg.norm(goal), 1e-12)
            for i in np.flatnonzero(rough >= BAR):
                if rough[i] <= score[w.doc[i]]:
                    continue
                tf = np.bincount(term[i:stop[i]], minlength=len(goal))
                other = tf[-1]  # every other word is a term of its own
                v = tf[:-1] * idf[:-1]
                size = np.sqrt((v ** 2).sum() + other * idf[-1] ** 2)
                cosine = float(v @ goal[:-1] / max(size * np.linalg.norm(goal), 1e-12))
                if cosine >= BAR and cosine > score[w.doc[i]] and self.held(w.hashes[i:stop[i]], self.marks[t]) == self.own[t]:
                    which[w.doc[i]], score[w.doc[i]] = t, min(1.0, cosine)
        return which, score


def own_licenses(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, path, license, score`` of every row by its own text."""
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path"), F.col("text").cast("binary"))
    scan = Scan(templates)

    def count(batches):
        hits, total = np.zeros(len(scan.terms) + 1, np.int64), 0
        for b in chunks(batches):
            w = Words(b, table=PLAIN)
            pair = np.unique(w.doc.astype(np.int64) * (len(scan.terms) + 1) + scan.term(w.hashes))
            hits += np.bincount(pair % (len(scan.terms) + 1), minlength=len(hits))
            total += b.num_rows
        hits[-1] = total
        yield record(term=np.arange(len(hits)), n=hits)

    seen = {r["term"]: r["n"] for r in
            map_arrow(rows.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = seen.get(len(scan.terms), 0)
    idf = np.array([np.log((total + 1) / (seen.get(i, 0) + 1)) + 1 for i in range(len(scan.terms))] + [np.log(total + 1) + 1])

    def match(batches):
        for b in chunks(batches):
            which, score = scan.best(Words(b, table=PLAIN), idf)
            yield record(doc_id=b.column("doc_id"), path=b.column("path"),
                         license=pa.array([scan.names[i] if i >= 0 else None for i in which], pa.string()),
                         score=pa.array(score, mask=which < 0))

    return map_arrow(rows, match, "doc_id long, path string, license string, score double")


def parent(path: str) -> F.Column:
    """The directory of a path ('' at the root)."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, path, text`` -> ``doc_id, path, license, score, origin`` (own,
    inherited or null) and ``from_path`` (the file that says so)."""
    own = stash(own_licenses(files, templates).withColumn("dir", parent("path")), "licenses")
    licensed = (own.where(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
                .groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("l"))
                .select(F.col("dir").alias("at"), F.col("l.license").alias("up_license"),
                        (-F.col("l.s")).alias("up_score"), F.col("l.path").alias("up_path")))
    parts = F.split("dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    dirs = own.where("dir is not null").select("dir").distinct()
    near = (dirs.select("dir", F.explode(F.array_distinct(ancestors)).alias("at")).join(licensed, "at")
            .groupBy("dir").agg(F.max(F.struct(F.length("at"), "up_license", "up_score", "up_path")).alias("n"))
            .select("dir", "n.up_license", "n.up_score", "n.up_path"))
    mine = F.col("license").isNotNull()
    return own.join(near, "dir", "left").select(
        "doc_id", "path", F.coalesce("license", "up_license").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("up_score")).alias("score"),
        F.when(mine, F.lit("own")).when(F.col("up_license").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("up_path")).alias("from_path"))
