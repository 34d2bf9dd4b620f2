"""Licence notices: lines and windows of words against templates by the Dice coefficient of word bigrams.

Three things are looked for in a text. Its \n-split lines are compared as wholes with the notices of
`TEMPLATES`. Windows of words, across line breaks and inside longer lines, are compared with those notices
and with the licence bodies beside this file. Short forms (`under the MIT License`, SPDX identifiers,
`CC BY-NC 4.0`) are too short for a coefficient and are found word by word.

A window and a template of a and b distinct bigrams can reach a coefficient d only if they share d / (2 - d)
of b, and a best window begins and ends with a shared bigram: only such windows are scored. A text without
any word that every match must hold is passed over at the start.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import text_batches, text_or_empty

#: Usual notices, one line each; fixed values.
TEMPLATES = {
    "mit": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-long": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "reserved": "All rights reserved.",
    "copyright": "Copyright, all rights reserved, no part may be reproduced without written permission.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "epl-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
}
#: Short name, long name and versions of the GNU licences.
GNU = [("GPL", "General Public License", ["2.0", "3.0"]), ("LGPL", "Lesser General Public License", ["2.1", "3.0"]), ("AGPL", "Affero General Public License", ["3.0"])]
#: The notice that programs under them carry; fixed value.
GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {long} as published by the Free Software Foundation, {which}."
TEMPLATES |= {
    f"{short.lower()}-{v}{suffix}": GNU_NOTICE.format(long=long, which=which.format(v=v.removesuffix(".0")))
    for short, long, versions in GNU
    for v in versions
    for suffix, which in (("-or-later", "either version {v} of the License, or (at your option) any later version"), ("-only", "version {v} of the License"))
}


#: Short forms: names of each licence, as they follow "under" or "License:".
NAMES = {
    "mit": ["MIT License", "MIT Licence", "Expat License"],
    "apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache License, v2.0", "Apache 2.0", "Apache Software License 2.0", "Apache License 2"],
    "bsd-2-clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD License"],
    "isc": ["ISC License", "ISC Licence"],
    "unlicense": ["Unlicense"],
    "mpl-2.0": ["MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v2.0", "Mozilla Public License, Version 2.0"],
    "cc0-1.0": ["CC0 1.0", "CC0", "Creative Commons Zero"],
    "bsl-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost License 1.0", "BSL 1.0"],
    "epl-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0", "EPL 1.0"],
    "epl-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0", "EPL 2.0"],
} | {
    f"{short.lower()}-{v}.{minor}": [f"{name} {form}" for name in (f"GNU {long}", f"GNU {short}", long, short) for form in (f"version {v}", f"v{v}", f"v{v}.{minor}", f"{v}.{minor}", f"version {v}.{minor}")] + [f"{short}v{v}", f"GNU {short}v{v}"]
    for short, long, v, minor in (("GPL", "General Public License", 2, 0), ("GPL", "General Public License", 3, 0), ("LGPL", "Lesser General Public License", 2, 1), ("LGPL", "Lesser General Public License", 3, 0), ("AGPL", "Affero General Public License", 3, 0))
}
#: What stands before a name.
LEADS = ["under", "under the", "under a", "under an", "under the terms of", "under the terms of the", "under either of", "under either of the", "License:", "Licence:"]
#: Creative Commons terms; their codes say enough without a lead.
CC_TERMS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
#: Each short form holds one of these words, or a pair of them with what separates words between.
CLUES = ["licen", "apache", "gpl", "bsd", "cc0", "creative"]
CLUE_PAIRS = re.compile("cc[^a-z0-9]+by|[em]pl[^a-z0-9]+[12]|bsl[^a-z0-9]+1|mit[^a-z0-9]+or[^a-z0-9]|[^a-z0-9]or[^a-z0-9]+mit")
#: What stands between alternatives.
BETWEEN = {"or", "and"}
#: Titles that say enough without a lead.
TITLES = {"apache-2.0": "Apache License, Version 2.0, January 2004"}


def words_of(text: str) -> list[str]:
    """Lower-case runs of a-z and 0-9."""
    return re.findall("[a-z0-9]+", text.lower())


def pairs_of(text: str) -> list[str]:
    ws = words_of(text)
    return [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def short_forms() -> dict[tuple[str, ...], str]:
    """Words of a short form -> licence."""
    out = {tuple(words_of(f"{lead} {name}")): k for k, names in NAMES.items() for name in names for lead in LEADS}
    out |= {tuple(words_of(f"SPDX-License-Identifier: {k}")): k for k in NAMES}
    out |= {tuple(words_of(title)): k for k, title in TITLES.items()}
    for code, term in CC_TERMS.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            k = f"cc-{code}-{v}"
            out |= {tuple(words_of(t)): k for t in (f"CC {code} {v}", f"under CC {code} {v}", f"Creative Commons {term} {v}", f"SPDX-License-Identifier: {k}")}
    return out


def bare_names() -> dict[tuple[str, ...], str]:
    """Words of a name or identifier -> licence; they count beside `or` and `and` where another such name is on the other side."""
    return {tuple(words_of(name)): k for k, names in NAMES.items() for name in (k, k.replace("-clause", " clause"), *names)} | {("mit",): "mit", ("isc",): "isc"}


def bodies() -> dict[str, str]:
    """Licence texts beside this file, read by the driver."""
    return {p.stem: p.read_text() for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def telling_words(pairs: list[str], least: float) -> list[str]:
    """Words of which a match must hold one: a match shares least / (2 - least) of the template's bigrams, and fewer than that have none of these words."""
    need = math.ceil(least * len(pairs) / (2 - least) - 1e-9)
    chosen: list[str] = []
    held = Counter(w for p in pairs for w in set(p.split(" ")))
    often = len(pairs) > 40  # long texts: frequent words of some length first, so that few are enough
    for word in sorted(held, key=lambda w: (-held[w] if often and len(w) > 6 else 0, -len(w), w)):
        if sum(not set(p.split(" ")) & set(chosen) for p in pairs) < need:
            break
        chosen.append(word)
    return chosen


class Finder:
    """Templates made ready; `find` gives the notices of one text."""

    def __init__(self, templates: dict[str, str], texts: dict[str, str], forms: dict[tuple[str, ...], str], least: float):
        held = [(k, pairs_of(v), whole) for group, whole in ((templates, True), (texts, False)) for k, v in sorted(group.items())]
        #: Licence, distinct bigrams, most bigrams of a window, whether whole lines are compared.
        self.held = [(k, len(set(v)), math.floor(len(v) * (2 - least) / least + 1e-9), whole) for k, v, whole in held if v]
        self.least, self.index, self.forms = least, {}, {}
        for t, v in enumerate(v for _, v, _ in held if v):
            for p in set(v):
                self.index.setdefault(p, []).append(t)
        for form, k in forms.items():
            self.forms.setdefault(" ".join(form[:2]), []).append((form, k))
        self.bare = bare_names() if forms else {}
        self.longest, self.firsts = max(map(len, self.bare), default=0), {b[0] for b in self.bare}
        told = {w for _, v, _ in held if v for w in telling_words(list(dict.fromkeys(v)), least)} | (set(CLUES) if forms else set())
        self.told = sorted((w for w in told if not any(o != w and o in w for o in told)), key=lambda w: (len(w), w))

    def may_match(self, low: str) -> bool:
        return any(w in low for w in self.told) or bool(self.forms and CLUE_PAIRS.search(low))

    def find(self, text: str) -> list[tuple[int, str, float]]:
        """line_no, licence, coefficient of the notices of a text."""
        low = text.lower()
        if not self.may_match(low):
            return []
        ws: list[str] = []
        starts = []
        for line in low.split("\n"):
            starts.append(len(ws))
            ws += words_of(line)
        pairs = [f"{a} {b}" for a, b in zip(ws, ws[1:])]
        hits: dict[int, list[int]] = {}
        for i, p in enumerate(pairs):
            for t in self.index.get(p, ()):
                hits.setdefault(t, []).append(i)
        lines = self.whole_lines(pairs, hits, starts, len(ws))
        inside = lambda a, b: any(x[3] <= a and b <= x[4] for x in lines)
        found = lines + [x for x in self.windows(pairs, hits) + self.phrases(ws, pairs) if not inside(x[3], x[4])]
        taken: list[tuple[int, int]] = []
        out = []
        for _, lost, name, a, b in sorted(found):
            if all(b < x or y < a for x, y in taken):
                taken.append((a, b))
                out.append((line_at(starts, a), name, -lost))
        return sorted(out)

    def whole_lines(self, pairs: list[str], hits: dict[int, list[int]], starts: list[int], n: int) -> list[tuple]:
        """Lines that match a notice as a whole: less shared, less alike, licence, first and last bigram (past the end)."""
        by_line: dict[int, set[int]] = {}
        for t, at in hits.items():
            if self.held[t][3]:
                for i in at:
                    by_line.setdefault(line_at(starts, i), set()).add(t)
        out = []
        for k, touched in by_line.items():
            a, b = starts[k], (starts[k + 1] if k + 1 < len(starts) else n) - 1
            own = set(pairs[a:b])
            shared = {t: sum(t in self.index.get(p, ()) for p in own) for t in touched}
            best = min((-2.0 * shared[t] / (len(own) + self.held[t][1]), self.held[t][0], shared[t]) for t in touched)
            if best[0] <= -self.least:
                out.append((-best[2], best[0], best[1], a, b))
        return out

    def windows(self, pairs: list[str], hits: dict[int, list[int]]) -> list[tuple]:
        """The best window from each shared bigram, as whole_lines gives them."""
        import numpy as np

        last: dict[str, int] = {}
        before = np.empty(len(pairs), dtype=np.int64)  # where a bigram stood last
        for i, p in enumerate(pairs):
            before[i] = last.get(p, -1)
            last[p] = i
        out = []
        for t, at in hits.items():
            name, m, most, _ = self.held[t]
            need = math.ceil(m * self.least / (2 - self.least) - 1e-9)
            if len(at) < need:
                continue
            pos = np.array(at)
            mine = np.zeros(len(pairs), dtype=bool)
            mine[pos] = True
            for a in pos[np.searchsorted(pos, pos + most) - np.arange(len(pos)) >= need].tolist():
                new = before[a : a + most] < a
                shared = np.cumsum(new & mine[a : a + most])
                dice = 2.0 * shared / (np.cumsum(new) + m)
                e = int(dice.argmax())
                if dice[e] >= self.least:
                    out.append((-int(shared[e]), -float(dice[e]), name, a, a + e + 1))
        return out

    def phrases(self, ws: list[str], pairs: list[str]) -> list[tuple]:
        """Short forms, word by word."""
        out = [(1 - len(form), -1.0, k, i, i + len(form) - 1) for i, p in enumerate(pairs) for form, k in self.forms.get(p, ()) if tuple(ws[i : i + len(form)]) == form]
        return out + self.alternatives(ws)

    def alternatives(self, ws: list[str]) -> list[tuple]:
        """Names of licences on both sides of `or` or `and`, the longest on each."""
        out = []
        sizes = range(self.longest, 0, -1)
        for i, w in enumerate(ws):
            if w in BETWEEN and i and i + 1 < len(ws) and ws[i + 1] in self.firsts:
                after = next((n for n in sizes if tuple(ws[i + 1 : i + 1 + n]) in self.bare), 0)
                before = next((n for n in sizes if n <= i and tuple(ws[i - n : i]) in self.bare), 0)
                if after and before:
                    out += [(1 - n, -1.0, self.bare[tuple(ws[a : a + n])], a, a + n - 1) for a, n in ((i - before, before), (i + 1, after))]
        return out


def line_at(starts: list[int], word: int) -> int:
    """The line that holds a word."""
    import bisect

    return bisect.bisect_right(starts, word) - 1


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, texts: dict[str, str] | None = None, forms: dict[tuple[str, ...], str] | None = None) -> DataFrame:
    """One row per notice: doc_id, line_no (from 0, where it begins), license, dice (rounded to 6 digits).

    A \n-split line takes the notice of `templates` with the highest coefficient of `least` or more, ties
    by name; texts (by default the bodies beside this file) and forms (by default `short_forms`) are looked
    for everywhere. Without any of the three nothing is found. Windows of words reach `least` to a notice or a licence body; short forms match whole. What
    lies in a matched line adds nothing to it. Of notices that overlap, the one with the most shared
    bigrams stays, then the most alike. Less than two words match nothing. Null and empty texts give no
    rows; rows that repeat a doc_id give their rows each. Other columns are ignored.
    """
    finder = Finder(templates, bodies() if texts is None else texts, short_forms() if forms is None else forms, least)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(d, *x) for d, t in zip(p["doc_id"].astype("Int64"), p["text"]) for x in finder.find(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "line_no", "license", "dice"])
            yield out.astype({"doc_id": "Int64", "line_no": "int32", "license": "object", "dice": "float64"})

    text_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, line_no int, license string, dice double")
    return found.withColumn("dice", F.round("dice", 6))
