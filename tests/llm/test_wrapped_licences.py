"""Licences as they stand in files: wrapped lines, comment marks, lists."""

import textwrap

from chronolith.llm import licenses

S = licenses.SENTENCES | licenses.MORE_SENTENCES


def wrapped(text, mark=""):
    return textwrap.fill(text, 70, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False)


def test_wrapped(spark):
    apache = "\n".join(
        ["/*", " * Copyright 2020 Somebody", " *", ' * Licensed under the Apache License, Version 2.0 (the "License");', " * you may not use this file except in compliance with the License."]
        + [" * You may obtain a copy of the License at", " *", " *     http://www.apache.org/licenses/LICENSE-2.0", " *", " * Unless required by applicable law", " */", "class A {}"]
    )
    bsd = wrapped(S["bsd-head"]) + "\n" + "\n".join(wrapped(f"{i}. {S[x]}.") for i, x in enumerate(["bsd-source", "bsd-binary"], 1))
    free = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU {} Public License as published by\n# the Free Software Foundation; either version {} of the License, or\n# (at your option) any later version."
    rows = [
        (1, apache),
        (2, "MIT License\n\nCopyright (c) 2020 X\n\n" + wrapped(S["mit-grant"]) + "\n\n" + wrapped(S["mit-notice"] + ".")),
        (3, wrapped(S["gpl-redistribute"] + ".", "// ") + "\n//\n" + wrapped(S["gpl-hope"] + "; without even the implied warranty", "// ")),
        (4, bsd),
        (5, bsd + "\n" + wrapped(f"3. {S['bsd-endorse']}.")),
        (6, free.format("General", "2")),
        (7, free.format("Lesser General", "2.1")),
        (8, wrapped(S["isc-grant"] + ".").replace("\n", "\r\n")),
        (9, wrapped(S["agpl3-redistribute"] + ".")),
        (10, "This is free and unencumbered software released into the\npublic domain."),
        (11, "Permission is hereby granted, free of charge,\n\nto any person"),
        (12, "Licensed under CC BY-SA 4.0"),
        (14, wrapped("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. " + S["mpl2-copy"] + ".", "// ")),
        (13, wrapped(S["lgpl3-redistribute"] + ".")),
    ]
    rows += [
        (20, "// SPDX-License-Identifier: BSL-1.0\nint main() {}"),
        (21, "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License."),
        (22, "This work is licensed under the GNU Affero General Public License, version 3."),
        (23, wrapped(licenses.SINGLE["Zlib"].replace(":", ".") + " And more.", " * ")),
    ]
    rows += [
        (24, wrapped("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "# ")),
        (25, wrapped("All rights reserved. " + licenses.SINGLE["EPL-1.0"], " * ")),
        (26, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nx"),
        (27, "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */"),
        (28, "# SPDX-License-Identifier: MPL-2.0 AND BSD-3-Clause"),
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
        if r.licence == "Apache-2.0" and r.doc_id == 1:
            assert (r.rule, r.n_sentences) == (0, 3)
        if r.licence == "MIT" and r.doc_id == 2:
            assert (r.rule, r.n_sentences) == (3, 2)
    assert got == {
        1: {"Apache-2.0"}, 2: {"MIT"}, 3: {"GPL-3.0-or-later"}, 4: {"BSD", "BSD-2-Clause"}, 5: {"BSD", "BSD-3-Clause"}, 6: {"GPL-2.0-or-later"}, 7: {"LGPL-2.1-or-later"},
        8: {"ISC"}, 9: {"AGPL-3.0-or-later"}, 10: {"Unlicense"}, 12: {"CC-BY-SA-4.0"}, 13: {"LGPL-3.0-or-later"}, 14: {"MPL-2.0"}, 20: {"BSL-1.0"}, 21: {"CC-BY-NC-SA-4.0"}, 22: {"AGPL-3.0-only"}, 23: {"Zlib"},
        24: {"GPL-2.0-only"}, 25: {"EPL-1.0"}, 26: {"MIT", "Apache-2.0"}, 27: {"GPL-2.0-or-later WITH Classpath-exception-2.0"}, 28: {"MPL-2.0", "BSD-3-Clause"},
    }


def test_own_catalogue(spark):
    """Any identifiers, two for one sentence, rules that repeat an identifier."""
    sentences = licenses.sentence_table(spark, {"a.*(": "Do what you like", "b,": "Do what  you LIKE!", "c": "keep this notice", "empty": "..."})
    rules = licenses.rule_table(spark, [("one", ["a.*(", "c", "a.*("]), ("two", ["b,"]), ("three", ["c", "b,", "c"])])
    rows = [(1, "Do what you like.\nKeep this notice.\nDo what you like."), (2, "Keep this notice. Do what you like."), (3, "...\n!"), (4, None)]
    got = {(r.doc_id, r.licence): r.rule for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), sentences, rules).collect()}
    assert got == {(1, "one"): 0, (1, "two"): 1, (2, "two"): 1}
