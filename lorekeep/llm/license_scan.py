"""Licence scan by sentence recognition.

Sentences are normalised (lower case, runs of anything but letters and digits as one
space) and mapped to the identifiers of known licence sentences. The sequence of a
text's identifiers, with the number of unknown sentences between neighbours, is then
matched against ordered rules: at each place the longest rule whose identifiers follow
each other with at most ``GAP`` unknown sentences between them; matches don't overlap.

A sentence ends with a full stop, exclamation or question mark, semicolon or colon
before white space (but not after Inc., Ltd., Corp. or Co.), or with a blank line. Texts that aren't wrapped put each sentence
on a line, so parts of a sentence from the start of any of its lines to the end of that
or a later one are looked up too, the longest first. Known sentences that hold such an
end themselves ("v. 2.0") are cut by it too and found where all their parts follow each
other; a part alone is an unknown sentence. A sentence that names whoever grants the
licence ("Neither the name of ... nor the names of ...") is known by what stands before and
after the name, of at most ``NAME`` characters.

Cases: null and empty texts, and texts with no known sentence, have no matches and
empty lists; repeated rows are texts of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, body

#: Unknown sentences that may stand between two neighbours of a rule.
GAP = 1

# Sentences of licence notices as their licences state them.
SENTENCES = {
    "mit-title": "The MIT License (MIT)",
    "mit-title-short": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-name-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-may": "The names of {name} may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name-may": "The name of {name} may not be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-free": "This program is free software",
    "gpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3-only-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl3-only-grant-of": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "gpl2-only-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2",
    "gpl2-only-grant-of": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    "agpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-grant": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-free": "This library is free software",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}
# Names by which notices call a licence.
NAMES = {
    "MIT": ("the MIT License", "the MIT license", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD License", "the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3"),
    "LGPL-2.1-only": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the GNU LGPL v2.1"),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the GNU LGPL v3"),
    "AGPL-3.0-only": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the GNU AGPL v3"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0"),
    "ISC": ("the ISC License",),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0"),
    "Zlib": ("the zlib License", "the zlib/libpng License"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0", "the Eclipse Public License v2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0"),
    "Unlicense": ("the Unlicense",),
}
PHRASES = {"licensed": "Licensed under {}", "released": "Released under {}", "distributed": "Distributed under {}", "work": "This work is licensed under {}", "project": "This project is licensed under {}", "program": "This program is licensed under {}"}
#: Identifiers that a tag line may state beside those with a name.
TAGGED = (*NAMES, "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "0BSD", "WTFPL", "PSF-2.0", "Artistic-2.0", "OFL-1.1", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")
SENTENCES |= {f"{licence}-{phrase}-{i}": pattern.format(name) for licence, names in NAMES.items() for i, name in enumerate(names) for phrase, pattern in PHRASES.items()}
SENTENCES |= {f"{licence}-tag": f"SPDX-License-Identifier: {licence}" for licence in TAGGED}
# Rules, each an SPDX identifier and the sentences that state it, in order.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("Apache-2.0", ("apache-name-the", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-name-the", "apache-use")),
    ("Apache-2.0", ("apache-name-the",)),
    *(("Apache-2.0", (f"Apache-2.0-licensed-{i}", "apache-use", *rest)) for i in range(3) for rest in (("apache-copy", "apache-basis", "apache-see"), ())),
    *(("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", names)) for names in ("bsd-names", "bsd-names-may", "bsd-name-may")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-grant", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-grant")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-grant", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-grant")),
    *((f"GPL-{v}.0-only", ("gpl-free", f"gpl{v}-only-grant{of}", *rest)) for v in "32" for of in ("", "-of") for rest in (("gpl-hope", "gpl-implied", "gpl-see"), ())),
    *((f"{family}-or-later", (free, grant, *rest)) for family, grant, see in (("AGPL-3.0", "agpl3-grant", "agpl-see"), ("LGPL-3.0", "lgpl3-grant", "lgpl-see"), ("LGPL-2.1", "lgpl21-grant", "lgpl-see")) for free, hope in (("gpl-free", "gpl-hope"), ("lgpl-free", "lgpl-hope")) for rest in ((hope, "gpl-implied", see), ())),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-distributed",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("ISC", ("isc-grant",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("Unlicense", ("unlicense-free",)),
    *((licence, (f"{licence}-{phrase}-{i}",)) for licence, names in NAMES.items() for i in range(len(names)) for phrase in PHRASES),
    *((licence, (f"{licence}-tag",)) for licence in TAGGED),
]
#: Every known sentence holds one of these, so that a text without any needs no splitting.
HINTS = ("licen", "permission", "redistribut", "copyright", "software", "warrant", "rights reserved", "public domain", "under cc", "distributed", "released")

#: A full stop after a company's form ends no sentence.
ENDS = re.compile(r"(?:(?<!\b[Ii]nc)(?<!\b[Ll]td)(?<!\b[Cc]orp)(?<!\b[Cc]o)\.|[!?;:])(?=\s|\Z)|\n[^\S\n]*\n")
NOISE = re.compile(r"[\W_]+")


def normalised(sentence: str) -> str:
    return NOISE.sub(" ", sentence.lower()).strip()


#: What stands for a name in a known sentence, and how long a name may be.
SLOT, NAME = "{name}", 120
#: Known sentences by their parts, each normalised; a part with a slot keeps it.
KNOWN = {tuple(SLOT.join(map(normalised, part.split(SLOT))) for part in ENDS.split(text) if normalised(part)): name for name, text in reversed(SENTENCES.items())}
PARTS = {part for parts in KNOWN for part in parts if SLOT not in part}
SLOTTED = [(part, *part.split(SLOT)) for parts in KNOWN for part in parts if SLOT in part]
#: Beginnings of known parts, whole words at a time, up to their slot.
BEGINNINGS = {" ".join(part.split(" ")[:n]) for part in (*PARTS, *(before for _, before, _ in SLOTTED)) for n in range(1, part.count(" ") + 2)}
MOST_PARTS = max(map(len, KNOWN))
#: The rules that begin with a sentence, the longest first.
STARTING: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _licence, _rule in sorted(RULES, key=lambda r: -len(r[1])):
    STARTING.setdefault(_rule[0], []).append((_licence, _rule))
assert all(any(h in " ".join(k) for h in map(normalised, HINTS)) for k in KNOWN), "a sentence without a hint"
assert all(s in SENTENCES for _, rule in RULES for s in rule), "a rule without its sentence"


def part_of(clean: str) -> str | None:
    """The known part that a normalised sentence is, names apart."""
    if clean in PARTS:
        return clean
    return next((part for part, before, after in SLOTTED if clean.startswith(f"{before} ") and clean.endswith(f" {after}") and len(before) + len(after) + 2 < len(clean) <= len(before) + len(after) + 2 + NAME), None)


def goes_on(clean: str) -> bool:
    """Whether a known part may begin with a normalised run of lines."""
    return clean in BEGINNINGS or any((clean == before or clean.startswith(f"{before} ")) and len(clean) <= len(before) + len(after) + 2 + NAME for _, before, after in SLOTTED)


def sentences(text: str) -> Iterator[tuple[str | None, int, int]]:
    """Sentences, and identified parts of them, in order: (identifier or None, start, end) in code points."""
    found: list[tuple[str | None, int, int, int]] = []
    at = 0
    for k, end in enumerate([*(m.start() for m in ENDS.finditer(text)), len(text)]):
        found += [(*x, k) for x in _identified(text, at, end)]
        at = end + 1
    i, unknown = 0, -1  # the cut whose unknown sentence has been told
    while i < len(found):
        part, start, end, k = found[i]
        n = 0
        if part is not None:
            n = next((n for n in range(min(MOST_PARTS, len(found) - i), 0, -1) if tuple(f[0] for f in found[i : i + n]) in KNOWN), 0)
        if n:
            yield KNOWN[tuple(f[0] for f in found[i : i + n])], start, found[i + n - 1][2]
            unknown = -1
        elif k != unknown:
            yield None, start, end
            unknown = k
        i += n or 1


def _identified(text: str, start: int, end: int) -> Iterator[tuple[str | None, int, int]]:
    """What a cut holds: (normalised part of a known sentence or None, start, end)."""
    whole = text[start:end]
    clean = normalised(whole)
    if not clean:
        return
    part = part_of(clean)
    if part is not None or "\n" not in whole:
        yield part, start, end
        return
    # lines that have words; a run of lines is looked at no further than known parts go
    lines, at = [], start
    for line in whole.split("\n"):
        words = normalised(line)
        if words:
            lines.append((words, at, at + len(line)))
        at += len(line) + 1
    i, unknown = 0, False
    while i < len(lines):
        joined, found, upto = "", None, i
        for j in range(i, len(lines)):
            joined = f"{joined} {lines[j][0]}".strip()
            part = part_of(joined)
            if part is not None:
                found, upto = part, j
            if not goes_on(joined):
                break
        if found is None:
            unknown = True
            i += 1
            continue
        if unknown:
            yield None, lines[i][1], lines[i][1]
            unknown = False
        yield found, lines[i][1], lines[upto][2]
        i = upto + 1
    if unknown:
        yield None, end, end


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Identified sentences, and matches (licence, start, end), of one text."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return [], []
    known: list[tuple[str, int, int]] = []
    gaps: list[int] = []  # unknown sentences before each known one
    between = 0
    for name, a, z in sentences(text):
        if name is None:
            between += 1
            continue
        known.append((name, a, z))
        gaps.append(between)
        between = 0
    matches, i = [], 0
    names = tuple(k[0] for k in known)
    while i < len(known):
        best = next(((licence, len(rule)) for licence, rule in STARTING.get(names[i], ()) if names[i : i + len(rule)] == rule and all(g <= GAP for g in gaps[i + 1 : i + len(rule)])), None)
        if best:
            matches.append((best[0], known[i][1], known[i + best[1] - 1][2]))
        i += best[1] if best else 1
    return known, matches


def scan_licences(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: path, sentences and matches, each an array of (name, start, end)."""
    shape = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [scan_text(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([[dict(zip(("name", "start", "end"), x, strict=True)) for x in f[k]] for f in found], shape) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["path", "sentences", "matches"])

    kind = docs.schema[path].dataType.simpleString()
    spans = "array<struct<name:string, start:int, end:int>>"
    return docs.select(F.col(path).alias("path"), body(text).alias("text")).mapInArrow(run, f"path {kind}, sentences {spans}, matches {spans}")


def licence_report(docs: DataFrame) -> DataFrame:
    """Per document: known sentences, matches, and the licences found."""
    found = scan_licences(docs)
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")
    licences = F.array_join(F.sort_array(F.array_distinct(F.transform("matches", lambda x: x["name"]))), ",")
    return found.select(F.col("path").alias("doc_id"), F.size("sentences").cast("long").alias("n_sentences"), F.size("matches").cast("long").alias("n_matches"), licences.alias("licences"), listed("sentences").alias("sentences"), listed("matches").alias("matches"))
