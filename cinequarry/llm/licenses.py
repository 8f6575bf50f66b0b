"""Licence scans by sentence rules: sentences become identifiers, and sequences of
identifiers are matched against ordered rules.

DataFrame functions only: no Python runs on executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences in normalised form (lower case, letters, digits and single spaces only) and their identifiers. Sentences of published licences and of the notices that name them.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license": "apache-2-notice",
    "this file is licensed under the apache license version 2 0": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "you may obtain a copy of the license at": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2-as-is",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "distributed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-keep-notice",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd-0-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-redistribution",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-redistribution",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd-no-endorsement",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-no-endorsement",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "this program is free software": "gpl-free-software",
    "this program is free software you can redistribute it and or modify it": "gpl-free-software",
    "this library is free software": "gpl-free-software",
    "under the terms of the gnu general public license": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "either version 2 1 of the license or at your option any later version": "lgpl-2-1-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "distributed under the boost software license version 1 0": "bsl-notice",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-copy",
    "you just do what the fuck you want to": "wtfpl-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "all rights reserved": "reserved",
}
#: GNU licences by the name in their sentences: short name, and the versions whose notices are known.
GNU = {"gnu general public license": ("gpl", (2, 3)), "gnu lesser general public license": ("lgpl", (3,)), "gnu affero general public license": ("agpl", (3,))}
#: Creative Commons licences: elements of the name, and versions.
CC, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("2.0", "3.0", "4.0")

#: Titles of licences and the identifiers of SPDX lines, by the licence's name; a title stands on a line of its own.
TITLES = {
    "Apache-2.0": ("apache license", "apache license version 2 0", "apache license version 2 0 january 2004"),
    "MIT": ("the mit license", "mit license", "the mit license mit"),
    "ISC": ("isc license", "the isc license"),
    "0BSD": ("bsd zero clause license", "zero clause bsd"),
    "BSD-2-Clause": ("bsd 2 clause license", "the 2 clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "the 3 clause bsd license"),
    "MPL-2.0": ("mozilla public license version 2 0",),
    "Zlib": ("zlib license", "the zlib license"),
    "Unlicense": ("the unlicense",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license version 1 0 august 17th 2003"),
    "WTFPL": ("do what the fuck you want to public license",),
    "EPL-2.0": ("eclipse public license v 2 0", "eclipse public license version 2 0"),
    "CC0-1.0": ("cc0 1 0 universal", "creative commons zero v1 0 universal"),
    "GPL-2.0-only": ("gnu general public license version 2 june 1991",),
    "GPL-3.0-only": ("gnu general public license version 3 29 june 2007",),
    "LGPL-3.0-only": ("gnu lesser general public license version 3 29 june 2007",),
    "AGPL-3.0-only": ("gnu affero general public license version 3 19 november 2007",),
}
#: Licences that have no title above but are named in SPDX lines.
SPDX_ONLY = ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "BSD-4-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
for _licence, _titles in TITLES.items():
    SENTENCES |= {x: f"title-{_licence}" for x in _titles}
for _licence in (*TITLES, *SPDX_ONLY):
    _told = _licence.lower().replace("-", " ").replace(".", " ")
    SENTENCES |= {f"spdx license identifier {_told}": f"spdx-{_licence}"}

#: What stands for a holder's own name in sentences, after normalising: (pattern, what it becomes). Other sentences aren't touched.
HOLDERS = (
    ("^neither the name of .{1,120}? nor the names of (?:its|their|the) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^nor the names of (?:its|their|the) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^this software is provided by .{1,120}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    ("^(?:portions )?(?:copyright|c) .{1,200}? all rights reserved$", "copyright all rights reserved"),
)
SENTENCES |= {"copyright all rights reserved": "reserved"}

for _name, (_short, _versions) in GNU.items():
    _grant = f"it and or modify it under the terms of the {_name} as published by the free software foundation"
    SENTENCES |= {f"you can redistribute {_grant}": f"{_short}-terms"}
    for _v in _versions:
        SENTENCES |= {f"this work is licensed under the {_name} version {_v}": f"{_short}-{_v}-notice", f"licensed under the {_name} version {_v}": f"{_short}-{_v}-notice"}
        SENTENCES |= {f"you can redistribute {_grant} either version {_v} of the license or at your option any later version": f"{_short}-{_v}-grant"}
SENTENCES |= {"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2-1-grant"}
for _cc in CC:
    for _v in CC_VERSIONS:
        _told = f"licensed under cc {_cc} {_v}".replace("-", " ").replace(".", " ")
        SENTENCES |= {x: f"cc-{_cc}-{_v[0]}-notice" for x in (_told, f"this work is {_told}") if _v.endswith(".0")}

#: Ordered rules: (licence, identifiers that must come in this order). A document has the licence of every rule that fits, unless an earlier rule that fits holds all its identifiers.
RULES = (
    ("Apache-2.0", ("apache-2-notice", "apache-2-compliance", "apache-2-as-is")),
    ("Apache-2.0", ("apache-2-notice",)),
    ("MIT", ("mit-notice", "mit-grant", "mit-keep-notice")),
    ("MIT", ("mit-grant", "mit-keep-notice")),
    ("MIT", ("mit-notice",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("bsd-0-grant",)),
    *[(f"{x.upper()}-{v}.0-or-later", need) for x, versions in GNU.values() for v in versions for need in ((f"{x}-terms", f"gpl-{v}-or-later"), (f"{x}-{v}-grant",))],
    ("LGPL-2.1-or-later", ("lgpl-terms", "lgpl-2-1-or-later")),
    ("LGPL-2.1-or-later", ("lgpl-2-1-grant",)),
    *[(f"{x.upper()}-{v}.0-only", (f"{x}-{v}-notice",)) for x, versions in GNU.values() for v in versions],
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-advertising", "bsd-no-endorsement")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-no-endorsement")),
    ("BSD-2-Clause", ("bsd-redistribution",)),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("Unlicense", ("unlicense-domain",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("WTFPL", ("wtfpl-copy", "wtfpl-grant")),
    ("EPL-2.0", ("epl-2-notice",)),
    ("CC0-1.0", ("cc0-waiver",)),
    *[(f"CC-{x.upper()}-{v}", (f"cc-{x}-{v[0]}-notice",)) for x in CC for v in CC_VERSIONS],
    *[(x, (f"title-{x}",)) for x in TITLES],
    *[(x, (f"spdx-{x}",)) for x in (*TITLES, *SPDX_ONLY)],
)
#: Told if no rule fits: a reservation of rights beside a licence is that licence's copyright line.
NO_LICENCE = ("Proprietary", "reserved")
#: Sentences end at . ! ? ; or : before white space, and at a line without letters and digits (such as a comment mark alone).
SENTENCE_END = r"[.!?;:](?:[\x20\x09-\x0D]|$)|\n[^A-Za-z0-9\n]*\n"
#: The tag of an SPDX line, whose colon ends no sentence, and what stands for it.
SPDX_TAG = (r"SPDX-License-Identifier:[\x20\x09]*", "SPDX-License-Identifier ")


def normalised(sentence: Column) -> Column:
    """Lower case, and a single space for whatever is no letter or digit: line ends, comment
    and list marks, quotes and punctuation. Holders' names in known sentences become one."""
    plain = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    for pattern, common in HOLDERS:
        plain = F.regexp_replace(plain, pattern, common)
    return plain


def sentence_ids(text: Column) -> Column:
    """Identifiers of a whole text's known sentences, in order, repeats included. A
    sentence can run over several lines; one that isn't known is read line by line."""
    names = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    known = lambda s: F.try_element_at(names, normalised(s))

    def read(sentence: Column) -> Column:
        lines = F.when(F.contains(sentence, F.lit("\n")), F.transform(F.split(sentence, "\n"), known)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(known(sentence)), lines)

    def first(found: Column) -> Column:
        """The whole sentence if it is known, else what its lines are."""
        return F.when(found[0].isNotNull(), F.slice(found, 1, 1)).otherwise(found)

    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), *SPDX_TAG), SENTENCE_END)
    return F.array_compact(F.flatten(F.transform(F.transform(parts, read), first)))


def licences(ids: Column) -> Column:
    """Licences of the rules that fit a sequence of identifiers, in the rules' order."""
    told = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    out, fits = [], []
    for at, (name, need) in enumerate(RULES):
        mine = told.rlike(" " + " (?:.* )?".join(map(re.escape, need)) + " ")
        for before, (_, other) in enumerate(RULES[:at]):
            if set(need) <= set(other):
                mine = mine & ~fits[before]
        fits.append(told.rlike(" " + " (?:.* )?".join(map(re.escape, need)) + " "))
        out.append(F.when(mine, F.lit(name)))
    name, reserved = NO_LICENCE
    found = F.array_distinct(F.array_compact(F.array(*out)))
    return F.when((F.size(found) == 0) & F.array_contains(ids, reserved), F.array(F.lit(name))).otherwise(found)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with sentence_ids and licences (array<string>, empty if none).

    Every sentence is normalised and looked up, however long; titles and SPDX lines, which
    name one licence, are sentences too, and holders' names in BSD clauses don't matter. A
    reservation of all rights counts as a licence only where no other is found. A null or empty text has
    none. Repeated rows are scanned one by one; other columns pass through, and columns
    of these names are replaced."""
    df = docs.withColumn("sentence_ids", sentence_ids(F.col(text_col)))
    return df.withColumn("licences", licences(F.col("sentence_ids")))
