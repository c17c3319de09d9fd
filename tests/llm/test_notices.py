"""The licences' own notices, whole, as files have them: wrapped, unwrapped, and behind signs of comments."""

import textwrap

import pytest

from statloom.llm import license

MIT = ["MIT License", "Copyright (c) 2020 Some Body", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."]
BSD2 = ["Copyright (c) 2019, Some Body. All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
BSD3 = [*BSD2, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
APACHE = ["Copyright 2021 Some Body", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."]
WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
GPL3 = ["Copyright (C) 2018  Some Body", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", WARRANTY]
GPL2 = ["Copyright (C) 2018  Some Body", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", WARRANTY]
GPL2_ONLY = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", WARRANTY]
LGPL21 = ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", WARRANTY]
AGPL3 = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", WARRANTY]
MPL2 = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
ISC = ["ISC License", "Copyright (c) 2004, Some Body", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES."]
ZLIB = ["Copyright (c) 2011 Some Body", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "1. The origin of this software must not be misrepresented;"]
UNLICENSE = ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."]
NOTICES = [("MIT", MIT), ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("Apache-2.0", APACHE), ("GPL-3.0-or-later", GPL3), ("GPL-2.0-or-later", GPL2), ("GPL-2.0-only", GPL2_ONLY), ("LGPL-2.1-or-later", LGPL21), ("AGPL-3.0-or-later", AGPL3), ("MPL-2.0", MPL2), ("ISC", ISC), ("Zlib", ZLIB), ("Unlicense", UNLICENSE)]
REFERENCES = [
    ("This project is licensed under the terms of the MIT license.", "MIT"), ("Released under the BSD 3-Clause License!", "BSD-3-Clause"), ("The code is available under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("Copyright (c) 2020 X. All rights reserved.", "proprietary"),
    ("Licensed under the GNU Lesser General Public License, version 3 or later.", "LGPL-3.0-or-later"), ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 FSF\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "GPL-3.0"),
    ("We talked about the MIT license, permission and warranty at length.", ""), ("licensed to drive", ""),
]


def forms(parts):
    """The notice as it is, wrapped, wrapped without empty lines, commented in two ways, and behind prose."""
    wrapped = ["\n".join(textwrap.wrap(p, 70)) or p for p in parts]
    plain = "\n\n".join(wrapped)
    star = "/*\n" + "\n".join((" * " + x).rstrip() for x in plain.split("\n")) + "\n */\nint main() {}"
    mark = "\n".join(("# " + x).rstrip() for x in plain.split("\n"))
    return ["\n\n".join(parts), plain, "\n".join(wrapped), star, mark, "Some words first.\nThen this:\n\n" + plain.replace("\n", "\r\n") + "\r\n\r\nAnd more."]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{name} {k}", x, name) for name, parts in NOTICES for k, x in enumerate(forms(parts))] + [(t, t, name) for t, name in REFERENCES]
    d = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    return [(rows[r.doc_id], r.licenses, r.ids) for r in license.scan(d).collect()]


def test_notices(found):
    wrong = [(what, name, got, ids) for (what, _, name), got, ids in found if got != [x for x in (name,) if x]]
    assert not wrong


def test_known_sentences(spark):
    """Each known sentence is found by itself, and has a stem."""
    every = [(name, s) for name, all_ in license.SENTENCES.items() for s in all_]
    d = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(every)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in license.scan(d).collect()}
    assert [(s, got[i]) for i, (name, s) in enumerate(every) if name not in got[i]] == []
    assert all(any(x in s.lower() for x in license.STEMS) for _, s in every)


def test_many_empty_lines(spark):
    text = "\n \n" * 200_000 + "Licensed under the MIT License." + " *\n" * 200_000
    assert license.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == ["MIT"]
