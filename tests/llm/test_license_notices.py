"""Published notices, titles and tags, wrapped and commented as files hold them."""

import pytest
from pyspark.sql import functions as F

from reelspan.llm import licenses

GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.
"""
TEXTS = {
    1: ("GPL-3.0", GPL.format(3)), 2: ("GPL-2.0", GPL.format(2)),
    3: ("LGPL-2.1", GPL.format("2.1").replace("General", "Lesser General").replace("program", "library")),
    4: ("AGPL-3.0", GPL.format(3).replace("General", "Affero General")),
    5: ("MIT", "// SPDX-License-Identifier: MIT\nint main() {}"), 6: ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */\n"),
    7: ("CC-BY-4.0", "This work is licensed under a Creative Commons\nAttribution 4.0 International License. Enjoy it."),
    8: ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n"
        "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
    9: ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n"),
    10: (None, "This program is free to use.\nThe general terms are published\nby the foundation of the library."),
    11: (None, "SPDX-License-Identifier: Zlib"), 12: (None, "SPDX-License-Identifier: MPL-1.1"),
    13: ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    14: (None, ""), 15: (None, "\n\n\n"), 16: (None, "no licence " * 2000),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, f"src{i}/x", t) for i, (_, t) in TEXTS.items()] + [(100 + k, f"other/{k}", f"plain words of file {k}\nand a license of work") for k in range(50)]
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


def test_published_notices(files):
    got = {r.doc_id: r.license for r in licenses.scan(files).collect()}
    assert {i: got[i] for i in TEXTS} == {i: name for i, (name, _) in TEXTS.items()}
    assert not any(got[100 + k] for k in range(50))


def test_sentences_over_line_ends(spark):
    t = spark.createDataFrame([("a\nb. c\n # \n\nd! e\x01f",)], "t string")
    assert t.select(licenses.wrapped_sentences(F.col("t"))).first()[0] == ["a b.", "c", "d!", "e", "f"]
