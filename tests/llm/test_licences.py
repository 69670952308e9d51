"""Licence scans: planted wordings, clean texts, windows."""

import random

import pyarrow as pa
import pytest

from listing_lifecycle_spark.llm import licences as L
from listing_lifecycle_spark.llm.licence_texts import TEMPLATES
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_planted_wordings_are_found(spark, texts_table, model):
    r = random.Random(1)
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("NOT text RLIKE '(?i)licen|rights reserved'").limit(200).collect()  # texts without a notice of their own
    rows, want = [], set()
    texts = [(f, t) for f, own in TEMPLATES.items() for t in own]
    for i, (family, t) in enumerate(texts):
        noise = clean[i].text
        lines = noise.split("\n")
        at = r.randint(0, len(lines))
        rows.append((i, "\n".join([*lines[:at], t.upper() if i % 5 == 0 else t, *lines[at:]])))
        want.add((i, family, at))
        inline = " ".join(noise.split()[:50])
        rows.append((1000 + i, f"{inline} {t} {inline}"))
        want.add((1000 + i, family, 0))
    rows += [(5000 + i, c.text) for i, c in enumerate(clean[100:])]
    found = {(x.doc_id, x.family, x.paragraph) for x in L.scan(texts_table(rows), model).collect()}
    print("MISSED", [(x, texts[x[0] % 1000][1][:60]) for x in sorted(want - found)], "EXTRA", sorted(found - want), model.least)
    assert len(found & want) >= 0.95 * len(want)
    assert not [x for x in found if x[0] >= 5000]
    assert len(found - want) <= 0.05 * len(want)


def test_skipped_windows_have_nothing_to_find(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every = L.Model(model.weights, model.bias, model.least, model.cues | True)
    assert sorted(map(str, L.scan(docs, model).collect())) == sorted(map(str, L.scan(docs, every).collect()))


def test_windows_cover_each_paragraph():
    token, row, line, first, stop, begin = L.windows(pa.array(["", "a b\n\nc", " ".join(["w"] * 60) + "\nlicense"]))
    assert [(int(x), int(y), int(b - a)) for x, y, a, b in zip(row, line, first, stop)] == [(1, 0, 2), (1, 2, 1), *[(2, 0, 24)] * 4, (2, 1, 1)]
    assert (first - begin)[2:6].tolist() == [0, 12, 24, 36] and token[-1] > 0


def test_odd_rows(spark, texts_table, model):
    rows = ODD + [(70, "Released under the MIT License."), (70, "Released under the MIT License."), (None, "x\nLicensed under CC BY-NC 4.0.")]
    found = sorted((x.doc_id or 0, x.family, x.paragraph) for x in L.scan(texts_table(rows), model).collect())
    assert found == [(0, "CC-BY-NC", 1), (70, "MIT", 0), (70, "MIT", 0)]
    assert L.scan(texts_table([]), model).count() == 0
    assert L.scan(texts_table(rows), L.fit(texts_table([]))).count() >= 0


def test_every_notice_of_the_documents_is_found(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text RLIKE '(?i)licensed|released|rights reserved'")
    family = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache"}
    want = {(r.doc_id, i, family[line]) for r in docs.collect() for i, line in enumerate(r.text.split("\n")) if line in family}
    assert {f for *_, f in want} == set(family.values())
    assert {(x.doc_id, x.paragraph, x.family) for x in L.scan(docs, model).collect()} == want


def test_a_short_notice_is_a_whole_line(spark, texts_table, model):
    found = L.scan(texts_table([(1, "x\nALL RIGHTS RESERVED\ny"), (2, "they have all rights reserved for others"), (3, "all rights"), (4, "All rights reserved.")]), model).collect()
    assert sorted((x.doc_id, x.family, x.paragraph) for x in found) == [(1, "Proprietary", 1), (4, "Proprietary", 0)]
    assert L.agreement(L.template_tokens("All rights reserved."), "Proprietary") == 1


def test_common_short_notices(spark, texts_table, model):
    """Comment marks, copyright lines, names and identifiers; the same words inside other text are none."""
    notices = {
        "# All rights reserved.": "Proprietary", "// ALL RIGHTS RESERVED": "Proprietary", "Copyright 2024 Example Ltd. All rights reserved.": "Proprietary", "Copyright (c) 2020-2024 A. Person. All rights reserved.": "Proprietary",
        "MIT License": "MIT", "License: MIT": "MIT", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL",
        "/* License: BSD-3-Clause */": "BSD", "<!-- SPDX-License-Identifier: MPL-2.0 -->": "MPL",
    }
    other = ["Mit", "License", "MIT students met", "the license of MIT and others", "they have all rights reserved for others", "Copyright 2024 Example Ltd.", "License: unknown", "MIT License of some other kind here"]
    rows = [(i, f"some words before\n{t}\nand after") for i, t in enumerate(notices)] + [(100 + i, f"a line\n{t}\nanother") for i, t in enumerate(other)]
    found = L.scan(texts_table(rows), model).collect()
    assert sorted((x.doc_id, x.paragraph, x.family) for x in found) == [(i, 1, f) for i, f in enumerate(notices.values())]


def test_many_notes_of_licences_hide_no_notice(spark, texts_table):
    clean = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("NOT text RLIKE '(?i)licen|rights reserved'").limit(60).collect()]
    notes = ["MIT License", "License: MIT", "under the Apache License", "see the GPL license", "released under GPL", "the MIT License (MIT)", "under the BSD license", "Apache 2.0"]
    hot = []
    for i in range(400):
        own = clean[i % len(clean)]
        hot.append((i, "\n".join([" ".join([*own[:8], notes[i % 8], *own[8:14]]), notes[(i + 3) % 8], " ".join(own[20:40])])))
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache", "Licensed under the GPL v3.": "GPL", "Released under the BSD license.": "BSD"}
    planted = [(1000 + i, f"{' '.join(clean[i][:30])}\n{text}") for i, text in enumerate(notices)]
    found = {(x.doc_id, x.family, x.paragraph) for x in L.scan(texts_table(planted), L.fit(texts_table(hot + planted))).collect()}
    assert found == {(1000 + i, family, 1) for i, family in enumerate(notices.values())}


def test_wrapped_notices_are_found_where_they_begin(spark, texts_table, model):
    noise = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("NOT text RLIKE '(?i)licen|rights reserved'").first().text.split()
    before, after = " ".join(noise[:9]), " ".join(noise[9:30])
    wrapped = {
        "Released under the\nMIT License.": "MIT", "Licensed under\nthe MIT License.": "MIT", "Released under the BSD\nlicense.": "BSD", "Licensed under\nthe Apache\nLicense, Version 2.0.": "Apache",
        "Licensed under the GNU Affero\nGeneral Public License, version 3.": "AGPL", "Released\r\nunder the MIT\r\nLicense.": "MIT",
    }
    rows = [(i, f"{before}\n{text}\n{after}") for i, text in enumerate(wrapped)]
    rows += [(100, "Released under the\n\nMIT License."), (101, "Released under the MIT License.\nReleased under the\nMIT License."), (102, "Released under the"), (103, "MIT License.")]
    found = L.scan(texts_table(rows), model).collect()
    short = [(100, 2, "MIT"), (103, 0, "MIT")]  # a name alone on its line is a notice of its own
    assert sorted((x.doc_id, x.paragraph, x.family) for x in found) == sorted([*[(i, 1, f) for i, f in enumerate(wrapped.values())], (101, 0, "MIT"), (101, 1, "MIT"), *short])
