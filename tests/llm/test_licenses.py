from sensorloom.llm import catalog, licenses
from tests.compare import connection, difference
from tests.llm.data import documents, empty, texts


def expected(text):
    """All windows of all lengths, template by template."""
    words = licenses.re.sub(licenses._NOT_WORD, " ", (text or "").translate(str.maketrans(licenses._UPPER, licenses._LOWER))).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = {}
    for name, t in licenses.TEMPLATES:
        grams = set(licenses.bigrams(t))
        most = licenses.longest(len(grams), licenses.THRESHOLD)
        if len(grams & set(pairs)) < 3:
            continue
        for lo in range(len(pairs)):
            for hi in range(lo, min(len(pairs), lo + most)):
                if pairs[lo] in grams and pairs[hi] in grams:
                    w = set(pairs[lo : hi + 1])
                    d = round(2 * len(w & grams) / (len(w) + len(grams)), 6)
                    if d >= licenses.THRESHOLD:
                        found[name] = max(d, found.get(name, 0))
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


CASES = [
    "Some words.\nReleased under the MIT License.\nMore words.",
    "LICENSED under the apache license,\tversion 2.0",
    "This work is licensed under the GNU General Public License, version 3",
    "Released under the MIT license, more or less, as it were",
    "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons\nto whom the Software is furnished to do so, subject to the following conditions:\n\nother",
    "Licensed under CC BY-NC 4.0.\r\nReleased under the MIT License.",
    "The tool is small and fast. Released under the MIT License. See the docs for more.",
    "Some prose that goes on for a while. Licensed under CC BY 4.0. And more of it.",
    "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * It is distributed in the hope that it will be useful\n */\nint main() {}",
    "# MIT\n\n" + licenses.TEMPLATES[[i for i, (n, t) in enumerate(licenses.TEMPLATES) if n == "MIT" and "NONINFRINGEMENT" in t][0]][1].replace(": ", ":\n\n").replace(". ", ".\n\n"),
    "license mit license mit license mit license " * 40 + "released under the mit license",
    "mit", "", None, "no licence at all in here",
]


def test_matches_equal_brute_force(spark):
    rows = texts() + [(1000 + k, t, "en", "a") for k, t in enumerate(CASES)]
    got = licenses.scan_licenses(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), [(h.license, h.dice) for h in r.license_hits]) for r in got) == sorted((str(i), expected(t)) for i, t, *_ in rows)
    found = {r.doc_id: [h.license for h in r.license_hits] for r in got}
    assert found[1000] == ["MIT"] and found[1004] == ["MIT"] and "CC-BY-NC-4.0" in found[1005]
    assert [found[k] for k in (1006, 1007, 1008, 1009)] == [["MIT"], ["CC-BY-4.0"], ["GPL-3.0"], ["MIT"]]
    assert found[1011] == found[1012] == found[1013] == found[1014] == []
    spans = {r.doc_id: [(h.first, h.last) for h in r.license_hits] for r in got}
    assert spans[1006] == [(6, 10)]


def test_digest_and_empty(spark):
    out = licenses.license_digest(licenses.scan_licenses(documents(spark, [(1, CASES[0], None, None), (2, None, None, None)]))).orderBy("doc_id").collect()
    assert [(r.n_licenses, r.licenses, r.best_license, r.best_dice) for r in out] == [(1, "MIT", "MIT", 1.0), (0, "", None, None)]
    assert licenses.scan_licenses(empty(spark)).collect() == []


def test_whole_table_equals_sql(spark):
    assert difference(spark, connection(), catalog.op10_licenses, catalog.oracle_sql()["op10_licenses"]) == ""


def test_steps_are_not_computed_anew_in_loops(spark):
    plan = licenses.scan_licenses(documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("zip_with") == 1
