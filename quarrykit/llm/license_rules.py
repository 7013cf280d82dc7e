"""Licence scan: known sentences, then ordered rules over sequences of sentence identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Identifier -> pattern over a whole normalised sentence (lower case, letters and digits, single blanks); named groups are slots that a rule's licence may use.
SENTENCES: dict[str, str] = {
    "mit_grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .* to deal in the software without restriction .* subject to the following conditions",
    "mit_notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_notice_next": r"the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    "as_is": r"(the|this) software is provided (by .*)?as is .*without (any |express or implied |any express or implied )*warrant(y|ies).*",
    "as_is_isc": r"the software is provided as is and .* disclaims? all warranties .*",
    "as_is_bsd": r"this software is provided by .* as is and any express or implied warranties .* are disclaimed",
    "no_liability": r"in no event shall .* be liable for any .*",
    "isc_grant": r"permission to use copy modify (and or|and|or) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": r"(\d )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": r"(\d )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": r"(\d )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache_line": r"(this .* is )?licensed under the apache license version 2 0( the license)?",
    "apache_comply": r"you may not use this (file|work) except in compliance with the license",
    "apache_basis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl2_line": r"(this (work|software|program|file) is )?(licensed|released|distributed) under the( terms of the)? gnu general public license( as published by the free software foundation)?( either)? version 2( only)?",
    "gpl3_line": r"(this (work|software|program|file) is )?(licensed|released|distributed) under the( terms of the)? gnu general public license( as published by the free software foundation)?( either)? version 3( only)?",
    "gpl_free": r"((this|the) )?[^ ]+( [^ ]+)? is free software you can redistribute it and or modify it under the terms of the gnu general public license( version (?P<v2>\d))? as published by the free software foundation( either version (?P<v>\d) of the license or at your option any later version)?",
    "lgpl_free": r"((this|the) )?[^ ]+( [^ ]+)? is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation either version (?P<v>\d( \d)?) of the license or at your option any later version",
    "agpl_free": r"((this|the) )?[^ ]+( [^ ]+)? is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version (?P<v>\d) of the license or at your option any later version",
    "gpl_hope": r"(this|the) (program|library|software|file|[^ ]+) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_copy": r"you should have received a copy of the gnu (lesser |library |affero )?general public license along with this (program|library|software|file).*",
    "lgpl_line": r"(this (work|software|library|file) is )?(licensed|released|distributed) under the( terms of the)? gnu lesser general public license( as published by the free software foundation)?(( either version| version| v) (?P<w>\d( \d)?))?.*",
    "agpl_line": r"(this (work|software|program|file) is )?(licensed|released|distributed) under the( terms of the)? gnu affero general public license( as published by the free software foundation)?(( either version| version| v) (?P<w>\d))?.*",
    "mpl_line": r"this source code form is subject to the terms of the mozilla public license v 2 0",
    "mit_line": r"(this (work|software|program|file) is )?(licensed|released|distributed) under the( terms of the)? mit license",
    "bsd_line": r"(this (work|software|program|file) is )?(licensed|released|distributed) under the( terms of the)? bsd (?P<n>[23])? ?(clause )?license",
    "cc_by_nc_line": r"(this (work|text|page) is )?licensed under (a )?(cc by nc|creative commons attribution non ?commercial) 4 0( international)?( license)?",
    "cc_by_sa_line": r"(this (work|text|page) is )?licensed under (a )?(cc by sa|creative commons attribution share ?alike) 4 0( international)?( license)?",
    "cc_by_line": r"(this (work|text|page) is )?licensed under (a )?(cc by|creative commons attribution) 4 0( international)?( license)?",
    "public_domain": r"this (work|software) is (free and unencumbered software )?(released|dedicated) (in)?to the public domain",
    "spdx": r"spdx license identifier .+",
    "copyright": r"copyright( c)?( \d{4})*( .*)?",
    "rights": r"all rights reserved",
}
#: Every known sentence holds one of these, so rows without any hold none.
KEYWORDS = ("licen", "copyright", "warrant", "permission", "redistribut", "spdx", "rights reserved", "public domain", "liable", "endorse")
#: Ordered rules (licence, identifiers in order): at a place in a text, the first rule that matches wins.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("GPL{v}", ("gpl_free", "gpl_hope", "gpl_copy")),
    ("GPL{v}", ("gpl_free", "gpl_hope")),
    ("LGPL{v}", ("lgpl_free", "gpl_hope", "gpl_copy")),
    ("LGPL{v}", ("lgpl_free", "gpl_hope")),
    ("AGPL{v}", ("agpl_free", "gpl_hope", "gpl_copy")),
    ("AGPL{v}", ("agpl_free", "gpl_hope")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "as_is_bsd", "no_liability")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "as_is_bsd", "no_liability")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_notice", "as_is", "no_liability")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_grant", "mit_notice_next", "as_is", "no_liability")),
    ("MIT", ("mit_grant", "mit_notice_next")),
    ("ISC", ("isc_grant", "as_is_isc", "no_liability")),
    ("ISC", ("isc_grant", "as_is_isc")),
    ("ISC", ("isc_grant", "as_is")),
    ("ISC", ("isc_grant",)),
    ("Apache-2.0", ("apache_line", "apache_comply", "apache_basis")),
    ("Apache-2.0", ("apache_line",)),
    ("GPL{v}", ("gpl_free",)),
    ("LGPL{v}", ("lgpl_free",)),
    ("AGPL{v}", ("agpl_free",)),
    ("GPL-2.0", ("gpl2_line",)),
    ("GPL-3.0", ("gpl3_line",)),
    ("LGPL{w}", ("lgpl_line",)),
    ("AGPL{w}", ("agpl_line",)),
    ("MPL-2.0", ("mpl_line",)),
    ("MIT", ("mit_line",)),
    ("BSD{n}", ("bsd_line",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_line",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_line",)),
    ("CC-BY-4.0", ("cc_by_line",)),
    ("Public-Domain", ("public_domain",)),
    ("{spdx}", ("spdx",)),
    ("All-Rights-Reserved", ("copyright", "rights")),
    ("All-Rights-Reserved", ("rights",)),
    ("Copyright-Notice", ("copyright",)),
]
#: Known sentences that never go on to another line.
ONE_LINE = frozenset(("copyright", "rights", "spdx"))
#: Known sentences have fewer words than this, so longer runs of lines are none.
MOST_WORDS = 220
_WORDS = re.compile(r"[^\W_]+")
_MARKER = re.compile(r"[\W_]*(?:\d{1,2}|[a-z])[.)]\s+", re.I)
_STOP = re.compile(r"(?<!\bv)[.!?;:](?=\s|\Z)")  # "v. 2.0" goes on


def normalise(sentence: str) -> str:
    """Lower-cased words of letters and digits between single blanks; punctuation, comment marks and line ends go."""
    return " ".join(_WORDS.findall(sentence.lower()))


@lru_cache(maxsize=1)
def _compiled() -> tuple[dict[str, list[tuple[str, re.Pattern]]], list[tuple[str, re.Pattern]]]:
    """Known sentences by their first word, as far as they have a fixed one, and the others."""
    by: dict[str, list[tuple[str, re.Pattern]]] = {}
    rest = []
    for k, p in SENTENCES.items():
        own = (k, re.compile(p))
        if m := re.match(r"[a-z]+(?= )", p):
            by.setdefault(m[0], []).append(own)
        else:
            rest.append(own)
    return by, rest


@lru_cache(maxsize=50_000)
def identify(plain: str) -> tuple[str, tuple[tuple[str, str], ...]] | None:
    """(identifier, slots) of the first known sentence that a normalised sentence is, or None."""
    by, rest = _compiled()
    for k, p in [*by.get(plain.split(" ", 1)[0], ()), *rest]:
        if m := p.fullmatch(plain):
            return k, tuple((x, y) for x, y in m.groupdict().items() if y)
    return None


def _runs(text: str) -> Iterator[list[tuple[int, int, str, bool, bool]]]:
    """Runs of atoms (start, end, normalised words, ends a line, may be followed by more of its sentence).

    Atoms end at . ! ? ; : before white space and at line ends. A sentence may go on over a
    line end, a colon or a semicolon; it ends at . ! ? and before a blank line (or one of
    marks alone) or a numbered list item, whose number isn't part of it.
    """
    run: list[tuple[int, int, str, bool, bool]] = []
    at = 0
    for line in text.split("\n"):
        begin, end = at, at + len(line)
        at = end + 1
        if not _WORDS.search(line):
            if run:
                yield run
                run = []
            continue
        if m := _MARKER.match(line):
            if run:
                yield run
                run = []
            begin += m.end()
        while begin < end:
            m = _STOP.search(text, begin, end)
            stop = m.end() if m else end
            plain = normalise(text[begin:stop])
            if plain:
                a = _WORDS.search(text, begin, stop).start()
                last = a + len(text[a:stop].rstrip())
                hard = bool(m) and m[0] in ".!?"
                run.append((a, last, plain, not text[stop:end].strip(), not hard))
                if hard:
                    yield run
                    run = []
            begin = stop
    if run:
        yield run


def sentences(text: str) -> Iterator[tuple[int, int, int, str, dict[str, str]]]:
    """(number, start, end, identifier, slots) of each known sentence, wrapped over lines or not; the longest reading wins.

    Other words between count as one sentence per 40 words begun, within a run.
    """
    k = 0
    for run in _runs(text):
        if not any(x in a[2] for a in run for x in KEYWORDS):
            k += -(-sum(a[2].count(" ") + 1 for a in run) // 40)
            continue
        i, idle = 0, 0
        while i < len(run):
            best, words, j = None, [], i
            lines, size = 0, 0
            while j < len(run) and size < MOST_WORDS:
                words.append(run[j][2])
                size += run[j][2].count(" ") + 1
                found = identify(" ".join(words))
                if found and not (lines and found[0] in ONE_LINE):
                    best = (j, *found)
                lines += run[j][3]
                j += 1
            if best is None:
                idle += run[i][2].count(" ") + 1
                i += 1
                continue
            k += -(-idle // 40)
            idle = 0
            j, name, slots = best
            own = dict(slots)
            if name == "spdx":
                own["spdx"] = text[run[i][0] : run[j][1]].partition(":")[2].strip(" \t*/#->;")
            yield k, run[i][0], run[j][1], name, own
            k += 1
            i = j + 1
        k += -(-idle // 40)


def _named(licence: str, slots: dict[str, str]) -> str:
    """A rule's licence with its slots filled: a version, a number of clauses, an SPDX expression."""
    v = slots.get("v")
    version = f"-{v.replace(' ', '.') if ' ' in v else v + '.0'}-or-later" if v else f"-{slots['v2']}.0-only" if slots.get("v2") else ""
    plain = f"-{w.replace(' ', '.') if ' ' in w else w + '.0'}" if (w := slots.get("w")) else ""
    return licence.replace("{v}", version).replace("{w}", plain).replace("{n}", f"-{slots['n']}-Clause" if slots.get("n") else "").replace("{spdx}", slots.get("spdx") or "SPDX")


def scan(text: str | None, most_gap: int = 2) -> list[tuple[str, str, int, int, int, int]]:
    """(licence, identifiers, first sentence, last sentence, start, end) of each rule met, in text order.

    From each known sentence not yet used, rules are tried in order; a rule's
    identifiers must follow each other with ``most_gap`` other sentences between at most.
    """
    known = list(sentences(text or ""))
    out, used = [], set()
    for i in range(len(known)):
        if i in used:
            continue
        for licence, names in RULES:
            if known[i][3] != names[0]:
                continue
            took = [i]
            for name in names[1:]:
                j = took[-1] + 1
                while j < len(known) and known[j][0] - known[took[-1]][0] - 1 <= most_gap and known[j][3] != name:
                    j += 1
                if j >= len(known) or known[j][0] - known[took[-1]][0] - 1 > most_gap:
                    break
                took.append(j)
            else:
                used.update(took)
                slots = {x: y for j in took for x, y in known[j][4].items()}
                out.append((_named(licence, slots), "+".join(names), known[i][0], known[took[-1]][0], known[i][1], known[took[-1]][2]))
                break
    return out


def find_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_gap: int = 2) -> DataFrame:
    """One row per licence found: id, licence, sentences, first_sentence, last_sentence, start, end.

    Whole texts are cut into sentences, over line ends where they are wrapped, normalised,
    mapped to known sentences and matched by ordered rules (see :func:`scan`); licences carry
    the versions and SPDX expressions that the text names; start and end count code points.
    Rows that hold none of the known sentences' keywords, null and empty texts among them,
    are passed over before any Python runs; texts of any length are scanned whole. Where
    readings tie the first known sentence and the first rule win. Repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored,
    whatever their names, and a null id stays null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    low = F.lower(F.col("t"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).filter(low.rlike("|".join(KEYWORDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t"):
            found = [(k, *x) for k, t in enumerate(b.column("t").to_pylist()) for x in scan(t, most_gap)]
            cols = list(zip(*found)) if found else [()] * 7
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(cols[0], pa.int32())), *[pa.array(c, k) for c, k in zip(cols[1:], kinds)]], ["id", "licence", "sentences", "first_sentence", "last_sentence", "start", "end"])

    return rows.mapInArrow(run, f"id {kind}, licence string, sentences string, first_sentence int, last_sentence int, start bigint, end bigint").withColumnRenamed("id", id_col)
