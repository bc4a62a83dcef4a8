from tidelog.llm import licenses as L

from .cases import frame

#: The notices of the documents, then other notices, texts that name no license, and conditions without the grant.
NOTICES = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "All rights reserved.": "reserved",
    "The MIT License (MIT)": "mit",
    "under the BSD 3-Clause License": "bsd",
    "Licensed under the GNU Lesser General Public License v3": "lgpl",
    "Mozilla Public License, version 2.0": "mpl-2.0",
    "Released under the ISC License": "isc",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "Released under the MIT Press imprint": "",
    "Licensed under the Apache License, Version 1.1.": "",
    "the apache helicopter": "",
    "a driving license; the license version": "",
}


def test_every_notice_has_its_label(spark):
    got = {r["doc_id"]: r for r in L.scan(frame(spark, list(enumerate(NOTICES)))).collect()}
    for i, (text, label) in enumerate(NOTICES.items()):
        labels = set(got[i]["labels"].split(",")) - {""}
        assert set(label.split(",")) - {""} <= labels and bool(label) == bool(labels), (text, labels)
        assert (got[i]["score"] >= L.LEAST) == bool(label)
        if label in ("mit", "apache-2.0"):
            assert labels == {label}


def test_long_templates_count_all_their_places(spark):
    words = [f"w{i}" for i in range(150)]
    long = [("whole", " ".join(words))]
    rows = [(0, " ".join(words)), (1, " ".join(words[44:])), (2, " ".join(words[:100]))]
    got = {r["doc_id"]: r for r in L.scan(frame(spark, rows), long=long).collect()}
    assert got[0]["labels"] == got[1]["labels"] == "whole" and got[2]["labels"] == ""
    assert got[0]["score"] == 1.0 and got[1]["score"] == 105 / 149


def test_whole_licenses_are_one_span(spark):
    whole = [(label, t) for label, t in L.TEMPLATES if len(t.split()) > L.MASK]
    assert {label for label, _ in whole} == {"mit", "isc", "bsd", "zlib", "unlicense"}
    prose = "a text before the license and "
    rows = [(i, prose + t.upper().replace(" ", ",\n", 40)) for i, (_, t) in enumerate(whole)]
    # With a word too many here and there the diagonals are neighbours; a half of a license is no whole one.
    torn = [(100 + i, " ".join([*t.split()[:60], "indeed", *t.split()[60:90], "so", *t.split()[90:]])) for i, (_, t) in enumerate(whole)]
    half = [(200 + i, " ".join(t.split()[: len(t.split()) // 2])) for i, (_, t) in enumerate(whole)]
    got = {r["doc_id"]: r for r in L.scan(frame(spark, rows + torn + half), long=whole).collect()}
    for i, (label, t) in enumerate(whole):
        n = len(t.split())
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
        assert any((s["label"], s["first"], s["last"]) == (label, len(prose.split()), len(prose.split()) + n) for s in got[i]["spans"])
        assert label in got[100 + i]["labels"].split(",") and got[100 + i]["score"] == (n - 3) / (n - 1)
        assert got[200 + i]["labels"] == ""
