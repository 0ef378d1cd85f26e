"""Licence headers that span sentences, lines and paragraphs inside longer documents."""

from zephyrlake.llm import licenses

PROSE = "the river ran past a mill and over the stones of the old town. children came by. nobody spoke of it again."
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program."""
BSD = licenses.TEMPLATES["BSD"].replace(" Redistributions", "\n\n* Redistributions")
WRAPPED = f"{PROSE}\nThis work is licensed under the\nGNU General Public License,\nversion 3.\n{PROSE}"


def test_headers_over_several_passages(spark):
    rows = [(1, f"{PROSE}\n\n{GPL}\n\n{PROSE}"), (2, f"{PROSE}\n\n{BSD}\n\n{PROSE}"), (3, WRAPPED), (4, f"{PROSE} {licenses.TEMPLATES['LGPL-2.1 header']} {PROSE}"), (5, f"{PROSE}\n\n{PROSE}"), (6, "Released under the MIT License. " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.licenses for x in licenses.license_scan(df).collect()}
    names = {d: {y.license for y in found} for d, found in got.items()}
    assert names == {1: {"GPL-3.0 header"}, 2: {"BSD"}, 3: {"GPL-3.0 notice"}, 4: {"LGPL-2.1 header"}, 5: set(), 6: {"MIT notice"}}
    assert all(max(y.dice for y in got[d]) > 0.9 for d in (1, 2, 3, 4)), [(d, [(y.dice, y.passage) for y in got[d]]) for d in (1, 2)]
    for found in got.values():
        for y in found:
            mine, want = set(licenses.bigrams(licenses.plain_words(y.passage))), set(licenses.bigrams(licenses.plain_words(licenses.TEMPLATES[y.license])))
            assert abs(y.dice - 2 * len(mine & want) / (len(mine) + len(want))) < 1e-9 and y.dice >= 0.8
