"""License scans by sentence rules, in DataFrame functions only.

A document's sentences are normalised (lower case, runs of anything but letters and digits one blank) and looked up among
known licence sentences. The identifiers that it has, in the order of the text, are matched against ordered rules: a
rule holds if its identifiers appear in its order, whatever stands between, and none that rules it out. The known
sentences and rules are constants of this module, looked up in a constant map. Only documents with one of the stems of
which every known sentence has one are taken apart; that skips nothing that could match.

Lines without a letter or digit part paragraphs, and so do copyright lines and lines that only name a licence, as notices
often have them above the grant. Within a paragraph, sentences end after ``.``, ``;``, ``:``, ``!`` or ``?`` before white
space, and at its end. Lines may be wrapped or stand for themselves: each paragraph is read both ways, and the reading
with more known sentences counts, the lines as they are if equal. Signs of comments are no letters, so commented notices
read like others. Known sentences are cut by the same rules and known by their longest piece.

Defined results: null or empty text has no sentence; repeated sentences keep each place; repeated rows are scanned each,
a null doc_id included; a text of any length is scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"

#: identifier: sentences in any wording that counts as the same. The wording of the licences' own notices.
SENTENCES: dict[str, list[str]] = {
    "mit-grant": [_MIT],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "apache-ref": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-limits": ["See the License for the specific language governing permissions and limitations under the License."],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-title": ["Version 2.0, January 2004"],
    "gnu-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gnu-2-title": ["Version 2, June 1991"],
    "gnu-21-title": ["Version 2.1, February 1999"],
    "gnu-3-title": ["Version 3, 29 June 2007"],
    "agpl-3-title": ["Version 3, 19 November 2007"],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "bsd-permit": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl-2-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "mpl-2-title": ["Mozilla Public License Version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "reserved": ["All rights reserved.", "Copyright, all rights reserved."],
}

#: SPDX identifier: names by which a sentence refers to the licence, after what REFERS replaces
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL v3", "GPL-3.0 License"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL v2", "GPL-2.0 License"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL v2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL v3"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL v3"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause License", "New BSD License", "Modified BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "LicenseRef-BSD": ["BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "CC0-1.0": ["CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License"],
}
#: the parts of Creative Commons licences, and of GNU licences by the letters before GPL
_CC = {"": "Attribution", "-SA": "Attribution-ShareAlike", "-NC": "Attribution-NonCommercial", "-ND": "Attribution-NoDerivatives", "-NC-SA": "Attribution-NonCommercial-ShareAlike", "-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"": ("program", "", ["2", "3"]), "L": ("library", "Lesser ", ["2.1", "3"]), "A": ("program", "Affero ", ["3"])}

for _part, _name in _CC.items():
    for _v, _region in (("4.0", "International"), ("3.0", "Unported")):
        NAMES[f"CC-BY{_part}-{_v}"] = [f"CC BY{_part} {_v}", f"Creative Commons {_name} {_v} {_region} License", f"Creative Commons {_name} {_v} License"]
for _spdx, _all in NAMES.items():
    SENTENCES[f"ref-{_spdx}"] = [f"Licensed under {x}" for x in _all] + [f"SPDX-License-Identifier: {_spdx}"]
SENTENCES["ref-Apache-2.0"].append("Licensed under the Apache License, Version 2.0.")
for _letter, (_, _kind, _versions) in _GNU.items():
    _terms = f"you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation"
    SENTENCES[f"{_letter.lower()}gpl-grant"] = [_terms]
    for _v in _versions:
        SENTENCES[f"{_letter.lower()}gpl-grant-{_v}"] = [f"{_terms}, either version {_v} of the License, or (at your option) any later version."]
        SENTENCES[f"{_letter.lower()}gpl-grant-{_v}-only"] = [f"{_terms}, version {_v} of the License.", f"{_terms}, version {_v}."]
for _v in ("2", "2.1", "3"):
    SENTENCES[f"either-{_v}"] = [f"either version {_v} of the License, or (at your option) any later version."]
    SENTENCES[f"version-{_v}"] = [f"version {_v} of the License."]

#: (licence, identifiers in order, identifiers that rule it out; None: any other); whole notices before references
RULES: list[tuple[str, list[str], list[str] | None]] = [
    ("MIT", ["mit-grant", "mit-notice"], []),
    ("ISC", ["isc-grant"], []),
    ("0BSD", ["0bsd-grant"], []),
    ("Apache-2.0", ["apache-ref", "apache-comply"], []),
    ("Apache-2.0", ["apache-title", "apache-terms"], []),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-endorse"], []),
    ("BSD-2-Clause", ["bsd-source", "bsd-binary"], ["bsd-endorse"]),
    ("MPL-2.0", ["mpl-2-ref"], []),
    ("MPL-2.0", ["mpl-2-title"], []),
    ("Unlicense", ["unlicense"], []),
    ("Zlib", ["zlib-warranty", "zlib-grant"], []),
    ("BSL-1.0", ["boost-grant"], []),
    ("GPL-2.0", ["gpl-title", "gnu-2-title", "gnu-verbatim"], []),
    ("GPL-3.0", ["gpl-title", "gnu-3-title", "gnu-verbatim"], ["lgpl-title", "agpl-title"]),
    ("LGPL-2.1", ["lgpl-title", "gnu-21-title", "gnu-verbatim"], []),
    ("LGPL-3.0", ["lgpl-title", "gnu-3-title", "gnu-verbatim"], []),
    ("AGPL-3.0", ["agpl-title", "agpl-3-title", "gnu-verbatim"], []),
]
for _letter, (_, _, _versions) in _GNU.items():
    for _v in _versions:
        _id, _spdx = f"{_letter.lower()}gpl-grant", f"{_letter}GPL-{_v if '.' in _v else _v + '.0'}"
        RULES += [(f"{_spdx}-or-later", [f"{_id}-{_v}"], []), (f"{_spdx}-or-later", [_id, f"either-{_v}"], []), (f"{_spdx}-only", [f"{_id}-{_v}-only"], []), (f"{_spdx}-only", [_id, f"version-{_v}"], [])]
RULES += [(_spdx, [f"ref-{_spdx}"], []) for _spdx in NAMES]
RULES.append(("proprietary", ["reserved"], None))

#: one of these is in every known sentence, lower-cased; each is a word or less, so that wrapping cannot part it
STEMS = ["licen", "copyright", "permission", "warrant", "reserved", "redistribut", "domain", "version", "mpl", "gpl", "cc0", "cc by", "distribution"]
#: (pattern, replacement), one after the other on lower-case text between line breaks: what parts paragraphs, each by an empty line
PARTS = [
    ("\r", ""),
    (r"\n([^a-z0-9\n]*(copyright[ :]+(\(c\)|©|[0-9]{4}|by )|\(c\) ?[0-9]{4}|© ?[0-9]{4})[^\n]*)", "\n\n$1\n"),
    (r"\n([^a-z0-9\n]*(the )?(mit|isc|bsd|zlib|expat|boost|apache|gnu)[a-z0-9 .()-]{0,40} licen[sc]e( \([a-z0-9 .-]{1,20}\))?( version [0-9.]+)?[^a-z0-9\n]*)\n", "\n\n$1\n\n"),
    (r"\n[^a-z0-9\x{80}-\x{10FFFF}]*\n", "\x01"),
]
#: what turns ends of sentences into line breaks, but not the colon of an SPDX tag
ENDS = [(r"([.;:!?])[ \t\n]+", "$1\n"), (r"identifier:\n", "identifier: ")]
#: on normal forms: the ways to refer to a licence are one
REFERS = (r"^(this |the |all )?(project |work |software |file |program |code |source code |library |document |documentation |article |text |content |contents |material )?(is |are )?(made )?(licensed|licenced|released|distributed|available|published|provided) under (the terms of )?(the |a |an )?(terms of )?(the )?", "licensed under ")
_ODD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def _python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


def normal(text: str) -> str:
    """The normal form of a known sentence, as the columns below form it."""
    return re.sub(REFERS[0], REFERS[1], re.sub(_python(_ODD), " ", text.lower()).strip())


def key(text: str) -> str:
    """The normal form by which a known sentence is found in a text: of the longest piece that ENDS makes of it."""
    low = text.lower()
    for pattern, to in ENDS:
        low = re.sub(pattern, to.replace("$", "\\"), low)
    return max(map(normal, low.split("\n")), key=len)


def known() -> dict[str, str]:
    """Normal form: identifier."""
    return {key(s): name for name, forms in SENTENCES.items() for s in forms}


def _ids(text: Column) -> Column:
    for pattern, to in ENDS:
        text = F.regexp_replace(text, pattern, to)
    forms = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, _ODD, " ")), *REFERS))
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    return F.filter(F.transform(forms, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (long, licence sentences found), ids (in order of the text), licenses (SPDX where there is one; in order of the rules)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low = F.lower("text")
    some = F.coalesce(F.greatest(*[F.contains(low, F.lit(s)) for s in STEMS]), F.lit(False))
    parted = F.concat(F.lit("\n"), low, F.lit("\n"))
    for pattern, to in PARTS:
        parted = F.regexp_replace(parted, pattern, to)
    none = F.array().cast("array<string>")
    # both readings of each paragraph first: an expression in a lambda runs wherever it is used
    both = plain.select("doc_id", F.when(some, F.transform(F.split(parted, "\x01"), lambda p: F.array(_ids(p), _ids(F.translate(p, "\n", " "))))).alias("read"))
    ids = F.flatten(F.transform("read", lambda r: F.when(F.size(F.get(r, F.lit(1))) > F.size(F.get(r, F.lit(0))), F.get(r, F.lit(1))).otherwise(F.get(r, F.lit(0)))))
    found = both.select("doc_id", F.coalesce(ids, none).alias("ids"))
    row = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    held = [F.when(F.col("row").rlike(has) & ~F.col("row").rlike(out), F.lit(name)) for name, has, out in patterns()]
    named = F.when(F.size("ids") > 0, F.array_distinct(F.array_compact(F.array(*held)))).otherwise(none)
    return found.withColumn("row", row).select("doc_id", F.size("ids").cast("long").alias("n_sentences"), "ids", named.alias("licenses"))


def patterns() -> list[tuple[str, str, str]]:
    """(licence, pattern of identifiers between bars for which its rule holds, pattern of those for which it does not)."""
    bars = lambda ids: [rf"\|{re.escape(x)}\|" for x in ids]
    return [(name, "^(" + "|".join(bars(seq)) + ")+$" if out is None else "(.*)".join(bars(seq)), "|".join(bars(out or [])) or "^$") for name, seq, out in RULES]
