"""License statements by conditional compression.

A text is cut into sentences, which end with their line; those with a cue word are candidate blocks. A sentence that goes on over
line breaks, up to its full stop or an empty line, is a block instead of its lines if a license is confirmed for the whole. A block is compressed with zstandard on its own
and once with each template as raw dictionary: the more of the block a template foretells, the smaller the
result. Templates are ranked by the reduction; the best ones are then compared word by word, and a license is confirmed
when what differs are few words and none that tells licenses apart (names, numbers, "not", "non", ...).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The usual wording of common licenses, one sentence per entry, under their SPDX identifiers.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense license."),
    "CC0-1.0": ("Released under the CC0 1.0 Universal license.", "Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "all-rights-reserved": ("All rights reserved.", "Copyright, all rights reserved."),
}
# Every template has one of these, and so has every block that is looked at.
CUES = ("licen", "copyright", "permission", "free software", "creative commons", "public domain", "rights reserved", "products derived", "gnu gpl")
# Words that may differ without changing the license.
PLAIN = frozenset("a an the this that these is are was be under of in to for by and or with as at on it its our your here all work works file files text document documents software program project code "
                  "content material article page site released licensed license licence distributed published provided available terms conditions see".split())
WINNERS = 5
# A sentence ends at . ! ? and white space, but not after a single letter ("v. 2.0"), or with its line.
_SENTENCE = re.compile(r"[^\n]*?(?:(?<![\s(][A-Za-z])[.!?]+(?=\s)|(?=\n)|\Z)\n?")
_WRAPPED = re.compile(r"\S(?:(?!\n[^\w\n]*\n).)*?(?:(?<![\s(][A-Za-z])[.!?]+(?=\s|\Z)|(?=\n[^\w\n]*\n)|\Z)", re.S)
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def _words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


def _flat(s: str) -> bytes:
    return " ".join(s.lower().split()).encode("utf-8", "surrogatepass")


@lru_cache(maxsize=1)
def _compressors() -> tuple:
    """One compressor without and one for each template; kept by a task's process."""
    def one(**more) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False, write_dict_id=False, **more)

    each = []
    for name, lines in TEMPLATES.items():
        for line in lines:
            raw = zstandard.ZstdCompressionDict(_flat(line), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            each.append((name, line, one(dict_data=raw)))
    return one(), each


def ranked(block: str) -> list[tuple[float, str, str]]:
    """(reduction, license, template) of all templates, best first; equal ones by name."""
    alone, each = _compressors()
    flat = _flat(block)
    base = len(alone.compress(flat))
    return sorted(((1.0 - len(c.compress(flat)) / base, name, line) for name, line, c in each), key=lambda r: (-r[0], r[1], r[2]))


def differences(block: str, template: str) -> tuple[list[str], int]:
    """Words that only one of both has in its place, and how many words agree."""
    a, b = _words(block), _words(template)
    out, same = [], 0
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            same += j - i
        else:
            out += ["-" + w for w in b[k:m]] + ["+" + w for w in a[i:j]]
    return out, same


@lru_cache(maxsize=50_000)
def scan(block: str) -> tuple[str | None, float, str, str]:
    """(license or None, reduction, template, differing words) of one block."""
    best = ranked(block)[:WINNERS]
    tried = []
    for r, name, line in best:
        differ, same = differences(block, line)
        telling = [w for w in differ if w[1:] not in PLAIN]
        tried.append((len(telling), len(differ), -r, name, line, " ".join(differ), same))
    telling, n, r, name, line, words, same = min(tried)
    confirmed = same >= 2 and telling == 0 and n <= max(2, same)
    return (name if confirmed else None), -r, line, words


@lru_cache(maxsize=1)
def _longest() -> int:
    """Words of the longest block that can be confirmed: at most as many words differ as agree."""
    return 2 * max(len(_words(line)) for lines in TEMPLATES.values() for line in lines) + 2


def _lines(text: str) -> Iterator[tuple[int, int, str]]:
    low = text.lower()
    if not any(c in low for c in CUES):
        return
    if len(low) != len(text):  # lower-casing can change lengths; then places are taken from the text itself
        low = text
    for m in _SENTENCE.finditer(text):
        part = low[m.start() : m.end()].lower()
        if any(c in part for c in CUES):
            raw = m.group()
            lead = len(raw) - len(raw.lstrip())
            yield m.start() + lead, m.start() + len(raw.rstrip()), raw.strip()


def _apart(some: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of `some` that overlap none of `others`; both are in order and without overlaps of their own."""
    starts = [o[0] for o in others]
    return [x for x in some if not (k := bisect_left(starts, x[1])) or others[k - 1][1] <= x[0]]


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, block) of the sentences with a cue word, places in code points."""
    lines = list(_lines(text))
    if not lines:
        return
    whole = []
    for m in _WRAPPED.finditer(text):
        block = m.group().rstrip()
        # A block of more words cannot be confirmed, so nothing is lost by leaving it to its lines.
        if "\n" in block and any(c in block.lower() for c in CUES) and len(_words(block)) <= _longest() and scan(block)[0]:
            whole.append((m.start(), m.start() + len(block), block))
    alone = [x for x in lines if scan(x[2])[0]]
    # Lines that are confirmed alone stay as they are.
    whole = _apart(whole, alone)
    yield from sorted(whole + _apart(lines, whole))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, block, license, template, reduction, differences), one row per candidate block.

    `license` is NULL where no template is confirmed; `differences` lists words the template lacks (+) and words it has
    more (-). Of equally good templates the first by name wins. NULL and empty texts give no rows. Repeated
    rows give repeated results; NULL ids stay NULL. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                for lo, hi, block in blocks(t):
                    name, r, line, words = scan(block)
                    out.append((i, lo, hi, block, name, line, r, words))
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "block", "license", "template", "reduction", "differences"])

    return rows.mapInPandas(run, f"doc_id {kind}, start int, end int, block string, license string, template string, reduction double, differences string")
