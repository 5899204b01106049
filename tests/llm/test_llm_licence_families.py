"""Licence families beyond the common ones, what is no licence, and the template comparison by brute force."""

from corpus_spark.llm import licences


def test_families_and_denials(spark):
    prose = [f"The report on chapter {k} of the work was read by all of the members, and the notes follow. They use it in this form." for k in range(200)]
    said = {
        "SPDX-License-Identifier: Apache-2.0": ["apache"], "SPDX-License-Identifier: MIT": ["mit"], "Licensed under the EUPL, Version 1.2": ["eupl"], "Licensed under the Eclipse Public License, version 2.0.": ["epl"],
        "Licensed under the Common Development and Distribution License": ["cddl"], "Licensed under CC BY-ND 4.0": ["cc"], "Released under the GNU Lesser General Public License": ["lgpl"], "Licensed under the GNU Affero General Public License": ["agpl"],
        "Licensed under the WTFPL": ["wtfpl"], "Released under the MIT License.": ["mit"], "This is not a test. Released under the MIT License.": ["mit"],
        "We do not ship software released under the MIT license.": [], "It isn't released under the MIT license": [], "The license of the work and the terms of use were discussed.": [],
    }
    rows = [(k, x) for k, x in enumerate([*prose, *said])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licences.scan(df, licences.fit(df)).collect()}
    wrong = {text: got[len(prose) + k] for k, (text, want) in enumerate(said.items()) if got[len(prose) + k] != want}
    assert not wrong
    assert not any(got[k] for k in range(len(prose)))


def test_confirmation_by_brute_force():
    notes = licences.Notices(licences.NOTICES)
    for text in ("released under the mit license", "you may not use this file except in compliance", "gnu general public license", "nothing of the kind", ""):
        w = licences.words(text)
        for family, notices in licences.NOTICES.items():
            best = 0.0
            for notice in notices:
                n = licences.words(notice)
                pairs = {(a, b) for a, b in zip(n, n[1:])}
                best = max(best, sum(any((a, b) == p for a, b in zip(w, w[1:])) for p in pairs) / len(pairs))
            assert abs(notes.confirmed(family, w) - best) < 1e-12
    assert licences.denied("we do not ship ") and not licences.denied("not so. ") and licences.denied("it isn’t ") and not licences.denied("")
