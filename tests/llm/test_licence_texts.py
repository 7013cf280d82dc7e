"""Standard licence texts as files and headers carry them: wrapped, commented, listed."""

import textwrap

import pytest

from quarrykit.llm import license_rules as lr

MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."]
ITEMS = ["1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
BSD_OPEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLOSE = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED."
ISC = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES."]
APACHE = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."]


def gnu(name, version, colon=":"):
    return [f"This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.", f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {name} for more details.", f"You should have received a copy of the GNU {name} along with this program.  If not, see <https://www.gnu.org/licenses/>."]


CASES = [
    ("MIT", MIT), ("BSD-3-Clause", [BSD_OPEN, *ITEMS, BSD_CLOSE]), ("BSD-2-Clause", [BSD_OPEN, *ITEMS[:2], BSD_CLOSE]), ("ISC", ISC), ("Apache-2.0", APACHE),
    ("GPL-3.0-or-later", gnu("General Public License", "3")), ("GPL-2.0-or-later", gnu("General Public License", "2", ";")), ("LGPL-2.1-or-later", gnu("Lesser General Public License", "2.1", ";")), ("AGPL-3.0-or-later", gnu("Affero General Public License", "3")),
]


@pytest.mark.parametrize("mark", ["", "// ", "# ", " * ", "-- "])
@pytest.mark.parametrize("width", [40, 72, 78, 10_000])
@pytest.mark.parametrize("name,parts", CASES)
def test_standard_texts(name, parts, width, mark):
    lines = []
    for p in parts:
        lines += [*textwrap.wrap(p.strip(), width, break_long_words=False, break_on_hyphens=False), ""]
    notice = "\n".join((mark + x).rstrip() for x in lines)
    text = f"First words of a file\n\n{mark}Copyright (c) 2021 Some Body\n{mark.rstrip()}\n{notice}\n\nint main() {{ return 0; }}"
    found = [x for x in lr.scan(text) if x[0] != "Copyright-Notice"]
    assert [x[0] for x in found] == [name]
    assert text[found[0][4] : found[0][5]].split()[0].strip("#/*- ") != "" and found[0][1].count("+") >= (1 if name == "ISC" else 2)


def test_identifiers_and_lines():
    for text, want in [
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"),
        ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("Copyright 2020 Foo, Inc. All rights reserved.", "All-Rights-Reserved"), ("© Copyright 2020 Foo", "Copyright-Notice"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ]:
        assert [x[0] for x in lr.scan(text)] == [want], text
    assert lr.scan("licence, permission and warranty in one line\nof no licence known") == []
    assert lr.scan("all\nrights reserved") == [] and lr.scan(None) == [] and lr.scan("") == []
    long = "permission " * 200_000 + "\n\nReleased under the MIT License."
    assert [x[0] for x in lr.scan(long)] == ["MIT"]


def test_table(spark):
    rows = [(None, "Released under the MIT License.", "l", 1), (2, "Released under the MIT License.", "l", 1), (2, "Released under the MIT License.", "l", 1), (3, None, "l", 1)]
    wide = "doc_id bigint, text string, licence string, start int"
    got = lr.find_licences(spark.createDataFrame(rows, wide)).collect()
    assert sorted((str(r.doc_id), r.licence) for r in got) == [("2", "MIT"), ("2", "MIT"), ("None", "MIT")]
    assert lr.find_licences(spark.createDataFrame([], wide)).collect() == []
