"""Licence scans: known texts, and the same in SQL."""

import time

import duckdb

from textloom.llm import op1_license_scan as op

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal. "
    "The above copyright notice and this permission notice shall be included in all copies!\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.'
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted; "
    "1. Redistributions of source code must retain the above copyright notice. "
    "2. Redistributions in binary form must reproduce the above copyright notice."
)
ROWS = [
    (1, None), (2, ""), (3, "nothing to see. Really"), (4, MIT), (5, f"Hello.\n{BSD}\n{MIT}"),
    (6, "Released under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."),
    (7, "Licensed under the Apache License, Version 2.0.\nbody\nAll rights reserved."),
    (8, "This work is licensed under the GNU General Public License, version 3.\nX"),
    (9, "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"), (None, "é. SPDX-License-Identifier: MIT\n"),
    (4, MIT), (10, "we are licensed under the Weird Licence"), (11, "Released under the MIT License.\n" * 3000),
]
LICENSES = {4: "MIT", 5: "BSD-2-Clause,MIT", 6: "CC-BY-NC,MIT", 7: "Apache-2.0", 8: "GPL-3.0", 9: "", None: "MIT", 10: "", 11: "MIT"}
UNMATCHED = {7: "Rights", 9: "MITLiability", 10: "OtherRef"}


def scanned(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS left", "2 AS ids")
    return op.scan(frame).collect()


def test_known_texts(spark):
    for row in scanned(spark, ROWS):
        assert row["licenses"] == LICENSES.get(row["doc_id"], "")
        assert row["unmatched"] == UNMATCHED.get(row["doc_id"], "")
    by_id = {r["doc_id"]: r for r in scanned(spark, ROWS)}
    assert by_id[4]["sentence_ids"] == "MITGrant,MITNotice,AsIsSoftware,MITLiability"
    assert by_id[1]["n_sentences"] == by_id[3]["n_sentences"] == 0
    assert by_id[11]["n_sentences"] == 3000


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    got = sorted((tuple(r) for r in scanned(spark, ROWS)), key=str)
    assert got == sorted(con.execute(op.sql()).fetchall(), key=str)


def test_empty_table(spark):
    assert op.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# One text for every pattern, with no other sentence beside it.
ALONE = [
    ("SpdxMIT", "SPDX-License-Identifier: MIT"), ("SpdxApache2", "SPDX-License-Identifier: Apache-2.0"),
    ("SpdxGPL2", "SPDX-License-Identifier: GPL-2.0-only"), ("SpdxGPL3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("SpdxBSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MITGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies"),
    ("ISCGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("AsIsSoftware", "The software is provided as-is"),
    ("MITLiability", "In no event shall the authors or copyright holders be liable"),
    ("BSDPre", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSDSource", "Redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", "Redistributions in binary form must reproduce the above copyright notice"),
    ("BSDEndorse", "Neither the name of X nor of Y may be used to endorse or promote products"),
    ("BSDAsIs", "This software is provided by the copyright holders and contributors as is"),
    ("BSDLiability", "In no event shall the copyright holder or contributors be liable"),
    ("ApacheCompliance", "You may not use this file except in compliance with the License"),
    ("ApacheObtain", "You may obtain a copy of the License at"),
    ("ApacheAsIs", "Unless required by applicable law or agreed to in writing"),
    ("ApacheGoverning", "See the License for the specific language governing permissions"),
    ("ApacheHead2", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("ApacheRef2", "It is released under the Apache License 2.0"),
    ("GPLFree", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU GPL"),
    ("GPLHope", "This program is distributed in the hope that it will be useful"),
    ("GPLCopy", "You should have received a copy of the GNU GPL"),
    ("AGPLRef", "Available under the GNU Affero General Public License"),
    ("LGPLRef", "Available under the GNU Lesser General Public License"),
    ("GPLRef3", "Available under the GNU General Public License v3"),
    ("GPLRef2", "Available under the GNU General Public License v2"),
    ("GPLRef", "Available under the GNU General Public License"), ("MITRef", "Available under the MIT License"),
    ("BSDRef", "Available under the BSD License"), ("MPLRef", "Available under the Mozilla Public License"),
    ("CCByNcSaRef", "Released under CC BY-NC-SA 4.0"), ("CCByNcNdRef", "Released under CC BY-NC-ND 4.0"),
    ("CCByNcRef", "Available under CC BY-NC 4.0"), ("CCBySaRef", "Released under CC BY-SA 4.0"),
    ("CCByRef", "Available under Creative Commons BY 4.0"), ("CC0Ref", "It is CC0."), ("Rights", "All\tRIGHTS  reserved."),
    ("OtherRef", "Available under a weird license"),
]


def test_every_sentence_alone(spark):
    assert [n for n, _ in ALONE] == [n for n, _ in op.SENTENCES]
    rows = [(i, f"Some prose. {text}\n") for i, (_, text) in enumerate(ALONE)]
    got = {r["doc_id"]: r["sentence_ids"] for r in scanned(spark, rows)}
    assert [got[i] for i in range(len(ALONE))] == [n for n, _ in ALONE]


MIT_WRAPPED = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING FITNESS AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD_WRAPPED = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES.
"""
GPL_WRAPPED = """This program is free software{sign} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.  See the GNU General Public License.

You should have received a copy of the GNU General Public License
along with this program.
"""
APACHE_WRAPPED = """Licensed under the Apache License,
Version 2.0 (the "License"); you may not use this file except in
compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
See the License for the specific language governing
permissions and limitations under the License.
"""
MIT_IDS = "MITGrant,MITNotice,AsIsSoftware,MITLiability"
BSD_IDS = "Rights,BSDPre,BSDSource,BSDBinary,BSDEndorse,BSDAsIs,BSDLiability"
APACHE_IDS = "ApacheHead2,ApacheCompliance,ApacheObtain,ApacheAsIs,ApacheGoverning"
WRAPPED = [
    (MIT_WRAPPED, MIT_IDS, "MIT"), (BSD_WRAPPED, BSD_IDS, "BSD-3-Clause"), (APACHE_WRAPPED, APACHE_IDS, "Apache-2.0"),
    (GPL_WRAPPED.format(sign=":"), "GPLFree,GPLHope,GPLCopy", "GPL-header"),
    (GPL_WRAPPED.format(sign=";"), "GPLFree,GPLHope,GPLCopy", "GPL-header"),
    ("Released under the MIT License\nReleased under the BSD License\nmore", "MITRef,BSDRef", "BSD,MIT"),
    ("It is released under the GNU General\nPublic License v3\nmore", "GPLRef3", "GPL-3.0"),
    ("All rights reserved\nSPDX-License-Identifier: MIT\n" + MIT_WRAPPED[MIT_WRAPPED.index("Permission") :], f"Rights,SpdxMIT,{MIT_IDS}", "MIT"),
    ("Released under the\n\nMIT License", "", ""), ("released under the MIT\n2. License", "", ""),
]


def test_sentences_over_lines(spark):
    rows, want = [], []
    for text, ids, licenses in WRAPPED:
        for sign in ["", "# ", "// ", " * ", "-- ", "rem "]:
            lines = [(sign + line).rstrip() if sign != "rem " else sign + line for line in text.split("\n")]
            if "2. License" not in text or not sign:
                for end in ["\n", "\r\n"]:
                    rows.append((len(rows), end.join(lines)))
                    want.append((ids, licenses))
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in scanned(spark, rows)}
    for i, expected in enumerate(want):
        assert (got[i], rows[i][1]) == (expected, rows[i][1])


def test_many_semicolons_take_linear_time(spark):
    words = "gnu " + ";" * 200_000
    other = "gnu " + "мир; труд; " * 40_000
    docs = spark.createDataFrame([(1, words), (2, other)], "doc_id long, text string")
    start = time.perf_counter()
    assert {r.n_sentences for r in op.scan(docs).collect()} == {0}
    assert time.perf_counter() - start < 60
