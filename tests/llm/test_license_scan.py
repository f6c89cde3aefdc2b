import re

import numpy as np

from fieldweave.llm import license_scan as ls

#: Notices as they are met; some are also training texts, or much like one (see ``apart``).
MET = [
("mit","This project is licensed under the terms of the MIT license."),
("mit","MIT License\nCopyright (c) 2019 Jane Doe"),
("mit","Code released under the MIT licence, see LICENSE for details."),
("mit","Licensed under MIT"),
("mit","This library is distributed under the MIT License. You are free to use it in commercial products."),
("mit","Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"),
("apache","Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
("apache","Copyright 2015 Google Inc. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
("apache","This software is released under the Apache 2.0 license."),
("apache","All code here is made available under Apache-2.0."),
("apache","Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
("gpl","This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
("gpl","Released under GPLv3."),
("gpl","This code is GPLv2+"),
("gpl","License: GPL-3.0-or-later"),
("gpl","You can use this under the GNU GPL, version 2."),
("gpl","distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\nGNU General Public License for more details."),
("lgpl","This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2 of the License, or (at your option) any later version."),
("lgpl","Licensed under LGPLv3"),
("lgpl","libfoo is available under the GNU Lesser General Public License (LGPL)."),
("agpl","This server is free software: you can redistribute it under the terms of the GNU Affero General Public License, version 3"),
("agpl","AGPLv3 licensed"),
("bsd","Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
("bsd","This software is BSD licensed (3-clause)."),
("bsd","Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
("bsd","Copyright (c) 2010 The Authors. Distributed under the 2-clause BSD license."),
("bsd","THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND\nANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE\nARE DISCLAIMED."),
("mpl","This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
("mpl","Licensed under MPL 2.0"),
("mpl","The software is available under the Mozilla Public License, version 2.0"),
("isc","Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies."),
("isc","ISC License Copyright 2018 Foo"),
("zlib","This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages"),
("zlib","distributed under the zlib/libpng License"),
("boost","Distributed under the Boost Software License, Version 1.0."),
("unlicense","This is free and unencumbered software released into the public domain."),
("cc0","To the extent possible under law, Foo has waived all copyright and related or neighboring rights to Bar."),
("cc0","This dataset is in the public domain (CC0)."),
("cc-by","Text is available under CC-BY 4.0"),
("cc-by","Except where otherwise noted, content is licensed under a Creative Commons Attribution 4.0 license."),
("cc-by-sa","Text is available under the Creative Commons Attribution-ShareAlike License"),
("cc-by-sa","Images: CC BY-SA 3.0"),
("cc-by-nc","Licensed under CC BY-NC 4.0."),
("cc-by-nc","This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
("gfdl","Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2"),
("artistic","You can redistribute it and/or modify it under the Artistic License."),
]
#: More notices in other words.
OTHER_WORDS = [
("mit","We chose the MIT license for this project; feel free to fork it."), ("mit","Source: MIT (c) Example Corp."), ("mit","[MIT](LICENSE) - have fun!"), ("mit","Everything in src/ falls under MIT terms, enjoy."),
("apache","The code in this repo uses Apache License 2.0, except for third-party parts."), ("apache","This project follows Apache 2.0 (the ALv2)."), ("apache","Lizenz: Apache-2.0"), ("apache","Copyright The Kube Authors, Apache-2.0 applies"),
("gpl","Our plugin is GPL v2, like WordPress itself."), ("gpl","Copyleft: GNU GPL 3 applies to all scripts"), ("gpl","license='GPLv3+'"), ("gpl","This kernel module is GPLv2 only, no later versions."),
("lgpl","We link dynamically since Qt is LGPL 2.1."), ("lgpl","License: LGPL-2.1-only"), ("lgpl","The bindings are LGPLv3, see COPYING.LESSER"),
("agpl","Affero GPL 3 covers our server code"), ("agpl","Self-hosters: mind AGPL-3.0 obligations"), ("agpl","dual: commercial or AGPLv3"),
("bsd","BSD-3-Clause (c) Regents"), ("bsd","Our parser is BSD licenced code, 2-Clause variant."), ("bsd","license = 'BSD-2-Clause'"),
("mpl","MPL-2.0, as Firefox uses"), ("mpl","Files here follow Mozilla's MPL 2.0"), ("isc","npm says: license ISC"), ("isc","OpenBSD prefers ISC licensing for new code"),
("zlib","Terms: zlib license, like SDL2"), ("boost","We use BSL-1.0, that is Boost's own license"), ("unlicense","See UNLICENSE or unlicense.org"), ("unlicense","The Unlicense applies here"),
("cc0","Data: CC0-1.0, no attribution needed"), ("cc0","We waive our copyright by CC0."), ("cc-by","Figures reuse: CC-BY-4.0 if you credit us"), ("cc-by","Icons by Font Awesome, CC BY 4.0"),
("cc-by-sa","Wikipedia text, CC-BY-SA 4.0"), ("cc-by-sa","Maps: ShareAlike, CC BY-SA 2.0"), ("cc-by-nc","Photos are CC BY-NC 2.0, ask before commercial use"), ("cc-by-nc","NonCommercial use only (CC-BY-NC-4.0)"),
("gfdl","Manual pages under GFDL 1.3"), ("gfdl","Old wiki dumps use GNU FDL, also called GFDL"), ("artistic","Perl modules: Artistic License or GPL, your choice of Artistic 2.0"), ("artistic","Licence: Artistic-2.0"),
]


def apart(text):
    """No training text holds the words in a row, and none shares over half of the word pairs."""
    words = re.findall(ls.WORD, re.sub("(?<![a-z0-9])" + ls.VERSIONED, r"\1 version \2", text.lower()))
    known = [t for own in [*ls.NOTICES.values(), ls.OTHERS] for t in own] + [s.format(n) for own in ls.NAMES.values() for n in own for s in ls.SENTENCES]
    pairs = [*zip(words, words[1:], strict=False)]
    for t in known:
        own = t.split()
        theirs = {*zip(own, own[1:], strict=False)}
        if f" {' '.join(words)} " in f" {t} " or sum(p in theirs for p in pairs) > len(pairs) / 2:
            return False
    return True


#: Written after the model's sentences were chosen, and not looked at when they were.
WRITTEN_AFTER = [
("mit", "Feel free to reuse this snippet (MIT)."), ("mit", "My dotfiles are MIT-licensed, do as you please"), ("mit", "Package metadata: MIT"), ("apache", "Kafka connectors ship as Apache-2.0 software"), ("apache", "We relicensed from GPL to Apache License 2.0 last year"),
("apache", "ALv2 / Apache-2.0 header required in each file"), ("gpl", "Linux drivers: GPL-2.0 with syscall note"), ("gpl", "Contributions become GPLv3 code"), ("gpl", "GNU General Public License v3, that's all"), ("lgpl", "glibc itself is LGPL-2.1 or newer"),
("lgpl", "Use of the SDK is free thanks to LGPLv3"), ("agpl", "Mastodon runs on AGPLv3 code"), ("agpl", "AGPL-3.0-only applies to the backend folder"), ("bsd", "FreeBSD style: BSD-2-Clause"), ("bsd", "New BSD License, as in Django"), ("bsd", "Code: 3-clause BSD"),
("mpl", "Rust crates here: MPL-2.0"), ("mpl", "weak copyleft by Mozilla Public License"), ("isc", "Small utility, ISC-licensed"), ("zlib", "GLFW is zlib licensed, and we are too"), ("boost", "Boost Software License 1.0 for headers"), ("unlicense", "Unlicense: do anything"),
("cc0", "Photos released by CC0 waiver"), ("cc0", "Creative Commons Zero data set"), ("cc-by", "Slides: CC-BY 4.0, please credit"), ("cc-by", "Creative Commons Attribution 4.0 covers lecture notes"), ("cc-by-sa", "Stack posts: CC-BY-SA 4.0"), ("cc-by-nc", "Artwork CC-BY-NC 4.0 only"), ("gfdl", "Handbook licensed by GNU Free Documentation License 1.3"), ("artistic", "CPAN standard: Artistic License 2.0"),
]
HELD_OUT = [x for x in [*MET, *OTHER_WORDS, *WRITTEN_AFTER] if apart(x[1])]
#: Licences of no family, and prose with their words.
UNKNOWN = [
    "Do what you want to public license", "Microsoft Public License (Ms-PL)", "The PHP License, version 3.01", "This work is licensed under the Open Database License",
    "The license fee for the software is 100 euros a year and is due in January", "The public library of the city is free and open to all", "He was granted permission to copy the document without restriction",
    "The committee shall meet in public and the use of the hall is free of charge to any person", "Redistribution of wealth and the use of public funds", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Work under the Open Government Licence v3", "A general of the army gave the public notice of the terms", "The source of the files was a binary star", "Some rights were reserved for the creative director of the commons",
]


def units(text, model):
    """Paragraphs and lines with a gate word, by plain Python."""
    text = re.sub("(?<![a-z0-9])" + ls.VERSIONED, r"\1 version \2", (text or "").lower())
    has = lambda t: re.search(model.pattern, t)
    for i, p in enumerate(re.split(ls.BLANK, text)):
        if has(p):
            yield i, -1, p
            lines = p.split("\n")
            if len(lines) > 1:
                yield from ((i, j, t) for j, t in enumerate(lines) if has(t))


def verdict(text, model):
    p = model.probabilities(text)
    family = [*model.families, "unknown"][int(p.argmax())] if p.max() >= ls.CERTAIN else "unknown"
    pairs = {g for g in ls.grams(re.findall(ls.WORD, text)) if " " in g}
    like = max((len(pairs & set(t)) / len(t) for t in ls.templates(family)), default=0.0) if family != "unknown" else 0.0
    return family, round(float(p.max()), 5), round(like, 5), family != "unknown" and like >= ls.ALIKE


def brute(docs):
    model = ls.train()
    return {(d, i, j): verdict(t, model) for d, text in docs for i, j, t in units(text, model)}


def run(spark, docs):
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, line int")
    return {(r.doc_id, r.paragraph, r.line): (r.family, round(r.probability, 5), round(r.likeness, 5), r.confirmed) for r in ls.scan(df.repartition(3)).collect()}


def close(a, b):
    return a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][3] == b[k][3] and abs(a[k][1] - b[k][1]) < 2e-5 for k in a)


def test_recall_on_held_out_notices():
    model = ls.train()
    assert len(HELD_OUT) >= 40 and len({f for f, _ in HELD_OUT}) >= 14 and all(apart(t) for _, t in HELD_OUT)
    right = [model.family(t) == f for f, t in HELD_OUT]
    assert np.mean([ok for x, ok in zip(HELD_OUT, right, strict=True) if x in WRITTEN_AFTER]) >= 0.8
    assert np.mean(right) >= 0.9, [x for x, ok in zip(HELD_OUT, right, strict=True) if not ok]
    found = [verdict(t.lower(), model) for t in UNKNOWN]
    assert sum(f[0] == "unknown" for f in found) >= 0.9 * len(UNKNOWN) and sum(f[3] for f in found) == 0


def test_probabilities_are_calibrated():
    model = ls.train()
    names, rows = [*model.families, "unknown"], ls.copies(99, 10)
    p = np.array([model.probabilities(" ".join(w)) for w, _ in rows])
    right = np.array([names[i] == names[label] for i, (_, label) in zip(p.argmax(1), rows, strict=True)])
    gaps = [abs(right[own].mean() - p.max(1)[own].mean()) * own.mean() for a in np.arange(0, 1, 0.1) if (own := (p.max(1) > a) & (p.max(1) <= a + 0.1)).any()]
    assert sum(gaps) < 0.05 and right.mean() > 0.85


def test_held_out_probabilities_are_calibrated():
    """On notices apart from the training texts, and licences of no family."""
    model = ls.train()
    names = [*model.families, "unknown"]
    rows = [*HELD_OUT, *(("unknown", t) for t in UNKNOWN)]
    p = np.array([model.probabilities(t) for _, t in rows])
    right = np.array([names[i] == f for i, (f, _) in zip(p.argmax(1), rows, strict=True)])
    assert abs(p.max(1).mean() - right.mean()) < 0.12, (p.max(1).mean(), right.mean())


def test_most_weights_are_zero_and_the_gate_loses_nothing():
    model = ls.train()
    assert np.mean([v == 0 for w in model.weights.values() for v in w]) > 0.8
    assert (ls.largest_margins(model.weights, model.bias, set(model.gate)) < 0).all()
    known = sorted({w for g in model.weights for w in g.split()} - set(model.gate))
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(known, rng.integers(1, 300))) for _ in range(300)] + [" ".join(known)]
    assert all(model.family(t) == "unknown" for t in texts)
    for w in model.gate:  # every way a word can stand in a text
        for t in (w, f"x {w} y", f"2.0{w}", f"é{w}é", f"a\n{w}\n", f"1.{w}-b", f"({w})"):
            if w in re.findall(ls.WORD, t):
                assert re.search(model.pattern, t), (w, t)


GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."


def test_equals_brute_force(spark):
    texts = ["Ou et de.\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.\nx", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", None, "", "no such thing",
             "He lost his driving license.\nCopyright 1999 by the author", "word " * 30_000 + "released under the MIT license", "UNLICENSED emitted", "MIT", f"x y\n \n\t\n\n{GPL}\n\nReleased under GPLv3.\r\n", "\n\n\nmit\n\n", "K MIT \u212a"]
    docs = [*enumerate(texts), (0, texts[0])] + [(100 + i, t) for i, (_, t) in enumerate(MET)] + [(200 + i, " ".join(w)) for i, (w, _) in enumerate(ls.copies(5, 2)[::3])]
    got = run(spark, docs)
    assert close(got, brute(docs))
    assert got[0, 0, 1][0] == "mit" and got[1, 0, 0][0] == "gpl" and got[2, 0, -1][0] == "cc-by-nc" and got[3, 0, -1][0] == "apache"
    assert all(got[k][3] for k in [(0, 0, 1), (1, 0, 0), (2, 0, -1), (3, 0, -1), (11, 1, -1)]) and got[11, 1, -1][0] == "gpl" and got[7, 0, 0][0] == "unknown"
    assert run(spark, []) == {}


def test_equals_sql(spark):
    import duckdb
    import pandas as pd

    from fieldweave.llm.queries import oracle_sql

    texts = [t for _, t in [*MET, *OTHER_WORDS]] + UNKNOWN + [None, "", f"x y\n \n\t\n\n{GPL}\n\nReleased under GPLv3.\r\n", "a\n\nlicensed under LGPLv2.1+\nfoo\n"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    names = "doc_id, paragraph, line, family, probability, likeness, confirmed"
    want = {r[:3]: (r[3], round(r[4], 5), round(r[5], 5), r[6]) for r in con.sql(f"SELECT {names} FROM ({oracle_sql()['op7_license_scans']})").fetchall()}
    assert close(run(spark, list(enumerate(texts))), want) and len(want) > 50


def test_planted_notices_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, docs)
    notice = {(d, i) for d, t in docs for i, line in enumerate((t or "").split("\n")) if re.search(r"[Ll]icense", line) and line.count("\n") == 0}
    assert notice and all(got[d, 0, i if (d, 0, i) in got else -1][3] for d, i in notice)
    wrong = [k for k, v in got.items() if v[3] and k[2] >= 0 and (k[0], k[2]) not in notice]
    assert not [k for k in wrong if "CC " not in dict(docs)[k[0]].split("\n")[k[2]]]


def test_model_does_not_hang_on_the_order_of_sums():
    """Threads and machines add in other orders: the rounded weights must be the same, as SQL and query may be made by different processes."""
    rows = ls.copies(1, 4)
    index = {g: i for i, g in enumerate(sorted({g for words, _ in rows for g in ls.grams(words)}))}
    x, y = ls._matrix(rows, index)
    w, b = ls.fit(x, y, len(ls.NOTICES) + 1)
    w2, b2 = ls.fit(x[::-1].copy(), y[::-1].copy(), len(ls.NOTICES) + 1)
    assert abs(w - w2).max() < 1e-10 and abs(b - b2).max() < 1e-10
