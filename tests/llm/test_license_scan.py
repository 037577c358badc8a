import re
from functools import cache

import pytest
import zstandard

from tokenloom.llm import license_scan

DATA = "/root/testdata/sf0.1"


@cache
def scanner():
    return license_scan.Scanner()


def found(text):
    return scanner().scan(text)[1]


def test_table(spark, odd, odd_rows, empty):
    df = spark.createDataFrame([
        (1, "intro\nReleased under the MIT License.\nend"), (2, "This work is licensed under the GNU General Public License, version 3.\nx"), (3, "no notice here"), (4, None),
        (5, dict(license_scan.NOTICES)["ISC"].replace("software", "program")), (6, "The license of a driver is not a notice."), (7, "Licensed under CC BY-NC 4.0.\nAll rights reserved."),
        (8, "x" * 50_000 + " Licensed under the Apache License, Version 2.0. " + "y" * 50_000), (8, "All rights reserved"),
    ], "doc_id long, text string")
    got = sorted((r.doc_id, r.licenses) for r in license_scan.scan(df).collect())
    assert got == [(1, "MIT"), (2, "GPL-3.0"), (3, ""), (4, ""), (5, "ISC"), (6, ""), (7, "CC-BY-NC-4.0,all-rights-reserved"), (8, "Apache-2.0"), (8, "all-rights-reserved")]
    assert license_scan.scan(odd).count() == len(odd_rows) and license_scan.scan(empty).count() == 0
    clash = df.selectExpr("*", "'n' AS n_blocks", "'l' AS licenses", "'m' AS missing", "'s' AS saving")
    assert sorted(map(str, license_scan.scan(clash).collect())) == sorted(map(str, license_scan.scan(df).collect()))


def test_every_template_names_itself():
    for name, text in license_scan.templates():
        assert license_scan._TRIGGER.search(text), text
        assert found(text) == name, text
        assert found("Copyright 2020 Someone.\n" + text.replace(" ", "\n * ", 2) + "\nend") == name


# what a notice says decides, and not what it resembles
PROBES = [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under the GNU Library General Public License, version 2.", "LGPL-2.0"),
    ("Licensed under the GNU General Public License, version 4.", ""),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("Licensed under CC BY-NC-XX 4.0 SA.", ""),
    ("Licensed under CC BY 4.0 NC", ""),
    ("Licensed under the Apache License, Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-1.1", ""),
    ("This is not licensed under the GNU General Public License, version 3.", ""),
    ("It is no longer released under the MIT License.", ""),
    ("We are not a bank. Released under the MIT License.", "MIT"),
    ("Released under the MIT License (No Attribution)", ""),
    ("Not all rights reserved.", ""),
    ("No rights reserved.", ""),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
    ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0.", "MPL-2.0"),
    ("Licensed under the GNU General Public License, version\n2. The end", "GPL-2.0"),
    ("Licensed under the Apache License, v2.0", "Apache-2.0"),
    ("Licensed under the terms of the MIT license.", "MIT"),
    ("Licensed under CC BY-NC 4.0. All rights reserved.", "CC-BY-NC-4.0,all-rights-reserved"),
]


@pytest.mark.parametrize(("text", "names"), PROBES)
def test_exact_wording_decides(text, names):
    assert found(text) == names
    assert found("stone " * 300 + ". " + text + "\n\n" + "river " * 300) == names


def test_clauses_tell_the_bsd_licenses_apart():
    head, one, two, three = license_scan._BSD, license_scan._BSD_SOURCE, license_scan._BSD_BINARY, license_scan._BSD_NAMES
    assert found(f"{head}: see the file.") == "BSD-style"
    assert found(f"{head}:\n\n1. {one}\n2. {two}\n") == "BSD-2-Clause"
    assert found(f"{head}:\n\n1. {one}\n2. {two}\n3. {three}\n") == "BSD-3-Clause"
    assert found(f"{head}:\n 1) {one}\n 2) {two}\n 3) {license_scan._BSD_ADVERT}\n 4) {three}\n") == "BSD-4-Clause"


def test_every_notice_of_a_line():
    short = {}
    for name, text in license_scan.templates():
        short.setdefault(name, text)
    assert found(". ".join(short.values())) == ",".join(sorted(short))
    notices = dict(license_scan.NOTICES)
    assert found(f"{notices['Zlib']} or {notices['Unlicense']}") == "Unlicense,Zlib"


def test_whole_notices_at_any_distance():
    for name, notice in license_scan.NOTICES:
        for gap in range(0, 1300, 130):
            prose = ("river stone " * 200)[:gap]
            assert found(f"Copyright 2020 Someone. {prose}. {notice} {prose} license") == name
        for wrap in ("\n", "\n * ", "\n" + " " * 40):
            assert found(f"Copyright 2020 Someone.\n{wrap.join(['stone'] * 70 + ['stone.'] + notice.split())}\nend") == name


def test_very_long_texts(long_text):
    notice = dict(license_scan.NOTICES)["Zlib"]
    n, names, *_ = scanner().scan(long_text[: 5 << 20] + ". " + notice + " " + long_text[5 << 20 :])
    assert (n, names) == (1, "Zlib")
    n, names, *_ = scanner().scan((notice + " ") * 1500)  # one block of a million characters
    assert (n, names) == (1, "Zlib")


def brute(text, agreement=0.9):
    """Ranking and differences from the definition: all templates, all windows of their own length, nothing strange."""
    words, starts, ends, breaks = license_scan.tokens(text)
    hits = []
    for t, (name, wording) in enumerate(license_scan.templates()):
        want = license_scan.tokens(wording)[0]
        hits += [(-len(want), t, i, name, len(want)) for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]
    out, taken = set(), set()
    for _, _, i, name, n in sorted(hits):
        if taken.isdisjoint(range(i, i + n)):
            taken.update(range(i, i + n))
            out.add(name)
    return ",".join(sorted(out))


def test_documents_against_brute_force(spark):
    """Every document with a license word: licenses, ranking by conditional compression, and differences."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in license_scan.query(spark, DATA).collect()}
    assert set(rows) == set(docs)
    alone, seen = zstandard.ZstdCompressor(level=3), 0
    for i, text in docs.items():
        if not re.search(r"(?i)licen[sc]|rights reserved", text or ""):
            assert rows[i].licenses == "" and rows[i].license is None
            continue
        seen += 1
        assert rows[i].licenses == brute(text), text
        best = []
        for words, _ in scanner().blocks(text):
            raw = " ".join(words).encode()
            for name, wording in license_scan.templates():
                given = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(license_scan.tokens(wording)[0]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                if name in rows[i].licenses.split(","):
                    best.append(round(1 - len(given.compress(raw)) / len(alone.compress(raw)), 6))
        if rows[i].licenses:
            assert (rows[i].missing, rows[i].added) == ("", "")
            assert rows[i].saving in best and rows[i].license in rows[i].licenses.split(",")
    assert seen > 100


def test_confirmation_is_the_best_alignment():
    """Missing and added words, against all ways to leave words out of short templates."""
    s = license_scan.Scanner(agreement=0.7)
    s.wording[0], s.counts[0] = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), None
    for block, missing, added in [
        ("alpha beta gamma delta epsilon zeta eta theta iota kappa", [], []), ("alpha beta x gamma delta epsilon zeta eta theta iota kappa", [], ["x"]),
        ("alpha gamma delta epsilon zeta eta theta iota kappa", ["beta"], []), ("alpha beta x gamma y delta z epsilon q zeta eta theta iota kappa", ["alpha", "beta"], ["y", "z", "q"]),
    ]:
        assert s.confirm(0, block.split())[2:] == (missing, added)
    assert s.confirm(0, "alpha beta not gamma delta epsilon zeta eta theta iota kappa".split())[3] == []  # the part after the decisive word alone
    assert s.confirm(0, "alpha beta gamma delta epsilon not zeta eta theta iota kappa".split()) is None
