import re

from pyspark.sql import functions as F

from cinequarry.llm import licenses

TEXTS = [
    None, "", "Nothing here.", "Licensed under the Apache License, Version 2.0.", "x y\nLicensed under CC BY-NC 4.0.\nz", "All rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Something else! The above copyright notice and this permission notice shall be included in all copies.",
    "The above copyright notice and this permission notice shall be included in all copies. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "Released under the MIT License.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.",
    "not released under the MIT License", "Released under the" + " " * 300 + "MIT License.", "# Released under the\n#\tMIT License", "A title\nReleased under the MIT License\nand more", "RELEASED   under the  MIT-License!", "a " * 50_000 + "\nReleased under the MIT License.",
    "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU General Public License",
]


def naive(text):
    ids = []

    def plain(x):
        x = " ".join(re.findall("[a-z0-9]+", x.lower()))
        for pattern, common in licenses.HOLDERS:
            x = re.sub(pattern, common, x)
        return x

    for part in re.split(licenses.SENTENCE_END, re.sub("SPDX-License-Identifier:[ \t]*", "SPDX-License-Identifier ", text or "")):
        for x in [part] if plain(part) in licenses.SENTENCES else part.split("\n"):
            if plain(x) in licenses.SENTENCES:
                ids.append(licenses.SENTENCES[plain(x)])

    def fits(need):
        at = iter(ids)
        return all(x in at for x in need)

    out = []
    for i, (name, need) in enumerate(licenses.RULES):
        if fits(need) and not any(set(need) <= set(other) and fits(other) for _, other in licenses.RULES[:i]) and name not in out:
            out.append(name)
    return ids, out or (["Proprietary"] if "reserved" in ids else [])


def test_scan(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] * 2
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, licences string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.sentence_ids, r.licences) == naive(TEXTS[r.doc_id]), r.doc_id
    told = {r.doc_id: r.licences for r in got}
    assert told[3] == ["Apache-2.0"] and told[6] == ["MIT"] and told[7] == [] and told[8] == ["MIT", "GPL-3.0-only"]
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, x string").where(F.lit(False))).count() == 0
