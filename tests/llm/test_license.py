import random

from veriframe.llm import op04_license as op


def test_held_out_accuracy():
    model, rng = op.trained(), random.Random(999)
    right = named = wrong = 0
    for text, y in op.labelled(rng, 1200):
        got = {x[2] for x in op.scan([text.encode()], model)}
        named += y > 0
        right += y > 0 and op.FAMILIES[y] in got
        wrong += bool(got - {op.FAMILIES[y]})
    assert right / named > 0.8
    assert wrong / 1200 < 0.005


def test_rows_and_edges(spark):
    notice = "Released under the MIT License."
    long = "x y z " * 5000 + "Licensed under the Apache License, Version 2.0 " + "a b " * 3000
    rows = [(1, f"a b\n\n{notice}\nc", "f"), (2, None, ""), (3, "", ""), (4, long, ""), (5, "a driving licence under the law", ""), (1, f"a b\n\n{notice}\nc", "f"), (None, notice.upper(), "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = sorted((r["doc_id"] or -1, r["paragraph"], r["family"]) for r in op.licenses(df).collect())
    assert got == [(-1, 0, "mit"), (1, 2, "mit"), (1, 2, "mit"), (4, 0, "apache")]
    assert op.licenses(df.limit(0)).count() == 0


def test_pieces_cover_paragraphs():
    for n in range(1, 400):
        cut = op.pieces(n)
        assert cut[0][0] == 0 and cut[-1][1] == n
        assert all(b[0] <= a[1] for a, b in zip(cut, cut[1:]))
        assert all(y - x <= op.PIECE + op.STRIDE for x, y in cut)


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"] for r in op.licenses(docs).select("doc_id").collect()}
    assert got == {r["doc_id"] for r in docs.filter("lower(text) rlike '(licensed|released) under|all rights reserved'").collect()}


def test_short_and_wrapped_notices():
    model = op.trained()
    got = lambda t: [(x[1], x[2]) for x in op.scan([t.encode()], model)]
    assert got("All rights reserved.") == [(0, "reserved")]
    assert got("Copyright 2021 Acme Inc. All rights reserved.") == [(0, "reserved")]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    assert [f for _, f in got("some prose here\n\n" + gpl)] == ["gpl"]
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"
    assert got("a\n\n" + bsd) == [(2, "bsd")]
    assert got("prose\nReleased under the MIT License.\nmore") == [(1, "mit")]
    assert got("we went on a drive\nwith the licence of the state\nand all the rights") == []


#: Notices as they are met in files, worded otherwise than the templates: (family, text).
MET = [
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use these files except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy and modify"),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "All code here is released under the MIT License, see LICENSE.txt for details"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This package is licensed under the GNU General Public License, version 2 or later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice"),
    ("bsd", "The work is licensed under the BSD 3-clause license (see COPYING)"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("unlicense", "This is free and unencumbered software released into the public domain. For more information, please refer to the site."),
    ("cc-by", "This book is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "The text of this page is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License; see the terms of use."),
    ("cc-by-nc-sa", "These slides are licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "The photographs are licensed under CC BY-ND 4.0"),
    ("cc0", "To the extent possible under law, the author(s) have waived all copyright and related or neighboring rights to this work and dedicated it to the public"),
    ("reserved", "Copyright (c) 2019 Some Company. All rights reserved."),
]


def wrapped(text, mark, width):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_recall_of_notices_as_they_are_met():
    """Plain, wrapped, in comments, and with the last fifth cut off, between lines of prose."""
    model, found, n, wrong = op.trained(), 0, 0, []
    for family, text in MET:
        words = text.split()
        for form in (text, wrapped(text, "", 72), wrapped(text, " * ", 60), wrapped(text, "# ", 40), wrapped(text, "// ", 72), " ".join(words[: max(6, len(words) * 4 // 5)])):
            got = {x[2] for x in op.scan([f"def x of the thing\n\n{form}\n\nand so it goes on".encode()], model)}
            found += family in got
            n += 1
            wrong += [(family, got)] * bool(got - {family})
    assert found >= 0.9 * n, (found, n)
    assert len(wrong) <= 0.03 * n, wrong


def test_against_a_plain_scan_for_templates():
    """Brute force: a line that is a template, whole, is found by comparison with all templates."""
    model, rng = op.trained(), random.Random(77)
    for family, templates in op.TEMPLATES.items():
        for t in templates:
            lines = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(8)) for _ in range(6)]
            at = rng.randrange(6)
            lines[at] = rng.choice((str, str.upper, str.title))(t) + rng.choice((".", "", ";"))
            plain = op.fold("\n".join(lines).encode()).decode().split("\n")
            want = {(i, f) for i, line in enumerate(plain) for f, ts in op.TEMPLATES.items() for x in ts if " ".join(op.fold(x.encode()).decode().split()) == " ".join(line.split())}
            got = {(x[1], x[2]) for x in op.scan(["\n".join(lines).encode()], model)}
            assert want == {(at, family)} and got == want, (t, got)


def test_headings_identifiers_and_the_named_family():
    """Short usual forms are found; templates of families that the classifier didn't name, or siblings, don't count."""
    model = op.trained()
    forms = {
        "SPDX-License-Identifier: BSD-2-Clause": "bsd", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl", "# SPDX-License-Identifier: GPL-2.0-only": "gpl", "MIT License": "mit", "// MIT License": "mit",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999": "lgpl",
    }
    found = op.scan([t.encode() for t in forms], model)
    named = {i: {f for k, _, f, *_ in found if k == i} for i in range(len(forms))}
    hits = sum(family in named[i] for i, family in enumerate(forms.values()))
    assert hits >= 6, named
    text = op.fold(op.TEMPLATES["mit"][-1].encode())
    words = op.end_to_end([text])[0]
    assert model.confirm("mit", words)[:2] == ("mit", 1.0)
    assert model.confirm("apache", words)[1] < op.CONFIRM
    assert model.confirm("isc", words)[0] == "mit"
