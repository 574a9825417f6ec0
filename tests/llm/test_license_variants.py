"""Licenses that differ in version or variant only, file headers and SPDX lines."""

from sensorloom.llm.license_scan import BANDS, NOTICES, scan_licenses

BSD = NOTICES["BSD-3-Clause"]
TEXTS = [
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"CC-BY-NC-4.0-text"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {"CC-BY-NC-SA-4.0-text"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
    ("This work is licensed under the GNU General Public License, version 4.", set()),
    (NOTICES["GPL-3.0-or-later-header"].replace("version 3", "version 2").replace(" ", "\n * ", 9), {"GPL-2.0-or-later-header"}),
    (NOTICES["LGPL-2.1-or-later-header"].replace("library", "program"), {"LGPL-2.1-or-later-header"}),
    (BSD[: BSD.index(" Neither")] + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"", {"BSD-2-Clause"}),
    (BSD.replace("the copyright holder nor", "ACME Inc nor"), {"BSD-3-Clause"}),
    ("one two\n// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x; SPDX-License-Identifier: LGPL-2.1-or-later.", {"(MIT OR Apache-2.0)", "LGPL-2.1-or-later"}),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
]


def test_version_and_variant_decide(spark):
    docs = spark.createDataFrame([(i, f"words before {t} words after") for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    rows = scan_licenses(docs).collect()
    assert {i: {r["license"] for r in rows if r["doc_id"] == i} for i in range(len(TEXTS))} == {i: x for i, (_, x) in enumerate(TEXTS)}
    assert {r["license"]: r["first_word"] for r in rows if r["doc_id"] == 8} == {"(MIT OR Apache-2.0)": 4, "LGPL-2.1-or-later": 14}


def test_bands_for_the_least_similarity():
    assert 1 - 0.75**BANDS >= 0.9999
