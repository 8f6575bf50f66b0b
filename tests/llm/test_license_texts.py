import textwrap

from cinequarry.llm import licenses

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
'''
BSD_2 = '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
'''
BSD_3 = BSD_2 + '''3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
'''
GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ZLIB = '''This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
'''
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
LGPL = GPL_3.replace("program", "library").replace("General", "Lesser General")
AGPL = GPL_3.replace("GNU General", "GNU Affero General")
ALL = [(MIT, ["MIT"]), (BSD_2, ["BSD-2-Clause"]), (BSD_3, ["BSD-3-Clause"]), (APACHE, ["Apache-2.0"]), (GPL_3, ["GPL-3.0-or-later"]), (GPL_2, ["GPL-2.0-or-later"]), (MPL, ["MPL-2.0"]), (ZLIB, ["Zlib"]), (ISC, ["ISC"]), (LGPL, ["LGPL-3.0-or-later"]), (AGPL, ["AGPL-3.0-or-later"])]


def wrapped(text, mark):
    """At 70 columns, every line after a comment mark."""
    lines = [x for part in text.split("\n") for x in textwrap.wrap(part, 70) or [""]]
    return "\n".join(f"{mark}{x}".rstrip() for x in lines)


def test_wrapped_and_commented_texts(spark):
    rows = [(i, mark, f"{mark}A readme of ours.\n{mark.rstrip()}\n{wrapped(t, mark)}\n") for i, (t, _) in enumerate(ALL) for mark in ("", "# ", " * ", "// ")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, mark string, text string")).collect()
    assert {(r.doc_id, r.mark): r.licences for r in got} == {(i, mark): want for i, (_, want) in enumerate(ALL) for mark in ("", "# ", " * ", "// ")}


def test_standard_texts(spark):
    want = [(MIT, ["MIT"]), (BSD_2, ["BSD-2-Clause"]), (BSD_3, ["BSD-3-Clause"]), (APACHE, ["Apache-2.0"]), (GPL_3, ["GPL-3.0-or-later"]), (GPL_2, ["GPL-2.0-or-later"])]
    docs = spark.createDataFrame([(i, f"A readme.\n\n{t}") for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].licences for i in range(len(want))] == [x for _, x in want]
    assert got[3].sentence_ids == ["apache-2-notice", "apache-2-compliance", "apache-2-copy", "apache-2-as-is"]


def licences_of(spark, texts):
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.licences for r in sorted(got, key=lambda r: r.doc_id)]


def test_copyright_lines_and_holders(spark):
    """A licence's own copyright line is no other licence, and holders have names of their own."""
    line = "Copyright (c) 2020, Foo Inc. All rights reserved.\n\n"
    other = "Copyright (c) 1990 The Regents of the University\nAll rights reserved.\n\n"
    held = lambda name: BSD_3.replace("the copyright holder nor", f"{name} nor")
    as_is = 'THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    texts = [line + BSD_3, other + BSD_2, line + held("the University"), other + held("Foo Inc.") + as_is, line + MIT, line, other, "Copyright 2021 Foo. All rights reserved", "no word of it"]
    want = [["BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-3-Clause"], ["MIT"], ["Proprietary"], ["Proprietary"], ["Proprietary"], []]
    assert licences_of(spark, texts) == want
    assert licences_of(spark, [wrapped(t, "# ") for t in texts]) == want


def test_titles_and_spdx_lines(spark):
    texts = [
        "MIT License\n\nCopyright (c) 2020 Foo\n\nsome words", "// SPDX-License-Identifier: Apache-2.0\n#include <x>", "/* SPDX-License-Identifier: GPL-2.0-or-later */", "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n",
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nwords", "# SPDX-License-Identifier: MIT\n\n" + BSD_2, "we like the MIT license and others", "SPDX-License-Identifier: LicenseRef-own",
    ]
    assert licences_of(spark, texts) == [["MIT"], ["Apache-2.0"], ["GPL-2.0-or-later"], ["Apache-2.0"], ["GPL-3.0-only"], ["BSD-2-Clause", "MIT"], [], []]
