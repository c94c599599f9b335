"""License scans by sentence rules.

Texts are cut into segments at line ends and sentence ends; each known license sentence that segments in a
row spell out is replaced by its identifier. A text thus becomes a short ordered list of identifiers, and
ordered rules over that list name the licenses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from smeltery.llm.text import table_of

# Sentences of public license texts and notices, and the license that an ordered list of them names.
SENTENCES = {
    "apache-named": "Licensed under the Apache License, Version 2.0.",
    "apache-granted": 'Licensed under the Apache License, Version 2.0 (the "License").',
    "apache-use": "You may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-named": "Released under the MIT License.",
    "mit-title": "MIT License",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-named": "Licensed under CC BY-NC 4.0.",
    "cc-by-named": "Licensed under CC BY 4.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl2-program": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only-program": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-library": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
RULES = [
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-granted", "apache-use", "apache-copy")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-program", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-program",)),
    ("Apache-2.0", ("apache-named",)),
    ("Apache-2.0", ("apache-granted",)),
    ("MIT", ("mit-named",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-3.0-only", ("gpl3-named",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-named",)),
    ("CC-BY-4.0", ("cc-by-named",)),
    ("GPL-2.0-or-later", ("gpl2-program",)),
    ("GPL-2.0-only", ("gpl2-only-program",)),
    ("LGPL-2.1-or-later", ("lgpl21-library",)),
    ("LGPL-3.0-or-later", ("lgpl3-program",)),
    ("AGPL-3.0-or-later", ("agpl3-program",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-old",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("Unlicense", ("unlicense-free",)),
]


def _gnu(kind: str, short: str, version: str) -> list[str]:
    """Names of one version of a GNU license, without what may follow on later versions."""
    numbers = [version, f"{version}.0"] if "." not in version else [version]
    return [f"{name} {v}{n}" for name in (f"GNU {kind} License", f"GNU {short}", short) for v in ("version ", "v", "") for n in numbers] + [f"{short}v{n}" for n in numbers]


def _creative(short: str, name: str, version: str = "4.0") -> list[str]:
    return [f"{short} {version}", f"Creative Commons {short} {version}", f"Creative Commons {name} {version}", f"Creative Commons {name} {version} International"]


_GNU = [
    ("GPL-2.0", _gnu("General Public", "GPL", "2")),
    ("GPL-3.0", _gnu("General Public", "GPL", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public", "LGPL", "2.1")),
    ("LGPL-3.0", _gnu("Lesser General Public", "LGPL", "3")),
    ("AGPL-3.0", _gnu("Affero General Public", "AGPL", "3")),
]
# Names by which a notice such as "This project is licensed under the ..." calls a license.
NOTICES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0", "Apache-2.0"],
    "MIT": ["MIT License", "MIT Licence"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD"],
    "ISC": ["ISC License", "ISC Licence"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": _creative("CC BY", "Attribution"),
    "CC-BY-SA-4.0": _creative("CC BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _creative("CC BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _creative("CC BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "Unlicense": ["Unlicense"],
    **{f"{name}-only": [*names, *[f"{n} only" for n in names]] for name, names in _GNU},
    **{f"{name}-or-later": [f"{n} {more}" for n in names for more in ("or later", "or any later version", "or (at your option) any later version")] for name, names in _GNU},
}

_WORD = re.compile(r"[^\W_]+")
_SEGMENT = re.compile(r"[^\n]*?(?:[.:;!?](?=\s|$)|\n|$)", re.S)


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Character ranges between line ends and sentence ends."""
    for found in _SEGMENT.finditer(text):
        if found.end() > found.start():
            yield found.start(), found.end()


class SentenceRules:
    """Known sentences by their first two words, rules in order of preference, and names that notices call.

    A notice is a phrase anywhere in a segment: licensed (released, distributed ...) under, then a name of
    ``notices``; after a "not" it is none. Its identifier is ``notice-`` and the license. Own sentences come
    without notices unless those are given.
    """

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, notices: dict[str, list[str]] | None = None):
        if notices is None:
            notices = NOTICES if sentences is SENTENCES else {}
        self.called = {normalised(n): license_id for license_id, names in notices.items() for n in names}
        names = "|".join(sorted(self.called, key=len, reverse=True))
        self.notice = re.compile(rf"(?<!\bnot )\b(?:licensed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |a |an )?({names})\b(?: licen[sc]e\b)?") if names else None
        self.by_head: dict[str, list[tuple[str, str]]] = {}
        for name, sentence in sentences.items():
            plain = normalised(sentence)
            self.by_head.setdefault(plain.split(" ")[0], []).append((plain, name))
        for known in self.by_head.values():
            known.sort(key=lambda x: -len(x[0]))
        heads = sorted({*self.by_head, "under"}, key=len, reverse=True)
        self.heads = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(map(re.escape, heads)) + r")(?![^\W_])")
        self.rules = [*rules, *[(license_id, (f"notice-{license_id}",)) for license_id in notices]]
        self.longest = max(map(len, (normalised(s) for s in sentences.values())))

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of known sentences, first to last; the longest wins where several start."""
        if not self.heads.search(text):
            return []
        parts = [(a, b, normalised(text[a:b])) for a, b in segments(text)]
        parts = [p for p in parts if p[2]]
        found, i = [], 0
        while i < len(parts):
            hit = None
            for plain, name in self.by_head.get(parts[i][2].split(" ", 1)[0], ()):
                j, spelled = i, parts[i][2]
                while len(spelled) < len(plain) and plain.startswith(spelled + " ") and j + 1 < len(parts):
                    j += 1
                    spelled += " " + parts[j][2]
                if spelled == plain:
                    hit = (name, parts[i][0], parts[j][1], j)
                    break
            if hit:
                found.append(hit[:3])
                i = hit[3] + 1
            else:
                found.extend(self._notices(text, *parts[i]))
                i += 1
        return found

    def _notices(self, text: str, start: int, end: int, plain: str) -> Iterator[tuple[str, int, int]]:
        if self.notice is None or " under " not in plain:
            return
        for hit in self.notice.finditer(plain):
            words = list(_WORD.finditer(text, start, end))
            whole = " ".join(w.group().lower() for w in words) == plain
            first, last = plain.count(" ", 0, hit.start()), plain.count(" ", 0, hit.end())
            yield (f"notice-{self.called[hit.group(1)]}", *((words[first].start(), words[last].end()) if whole else (start, end)))

    def licenses(self, names: list[str]) -> list[str]:
        """Licenses whose rule matches identifiers in a row, in order; the first rule that fits takes them."""
        out, i = [], 0
        while i < len(names):
            for license_id, rule in self.rules:
                if tuple(names[i : i + len(rule)]) == rule:
                    out.append(license_id)
                    i += len(rule)
                    break
            else:
                i += 1
        return out


def scan_licenses(docs: DataFrame, rules: SentenceRules | None = None, text: str = "text") -> DataFrame:
    """All rows with sentences (id, start, end in characters) and licenses added; such columns are replaced.

    Case, signs and line breaks inside a sentence do not matter, its words do. ``licenses`` are distinct and
    in order of first sight. Notices ("... is licensed under the MIT License") count inside a segment as well. Null and empty texts have none. Known sentences that no rule takes stay in
    ``sentences``. Whole texts are read.
    """
    docs = docs.drop("sentences", "licenses")
    shared = docs.sparkSession.sparkContext.broadcast(rules or SentenceRules())
    names = docs.columns
    sentence = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("sentences", sentence), T.StructField("licenses", T.ArrayType(T.StringType()))])
    kind = pa.list_(pa.struct([("id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = shared.value
        for batch in batches:
            found, named = [], []
            for value in batch.column(text):
                hits = engine.sentences(value.as_py() or "")
                found.append([{"id": n, "start": a, "end": b} for n, a, b in hits])
                named.append(list(dict.fromkeys(engine.licenses([n for n, _, _ in hits]))))
            yield table_of(batch, names, pa.array(found, kind), pa.array(named, pa.list_(pa.string())), more_names=("sentences", "licenses"))

    return docs.mapInArrow(run, schema)
