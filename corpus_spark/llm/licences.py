"""Operator 3: licence scans by a trained paragraph classifier.

A sparse word n-gram (one and two words) multinomial logistic regression, fitted by Spark ML on
variants of public notices and of the paragraphs of public licence texts, whole and in part, and on a bounded sample of the corpus' own lines as the unknown class: about
``sample_lines`` lines, chosen by hash from all lines of about ``sample_docs`` documents. Lines that share
words with a notice without being one belong to it, and a passage that its sentence denies is none. The
probability that a passage must reach is calibrated on held-out lines of the unknown class; a comparison
with the family's notices then confirms the prediction: enough of a notice's word pairs must be there.
Only n-grams of the notices carry weights, and no passage without their word pairs could be confirmed, so
passages are the stretches of a line around such pairs, or of consecutive lines of a paragraph where a
notice is wrapped. Lines without words end a paragraph.

Null and empty texts have no licence; very long texts are scanned whole. Repeated rows and ids are
scanned each; equally likely families go by name. An empty table gives no rows; with no text to learn
from nothing is found. Other columns, whatever their names, have no part in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Public notices of each family, and the paragraphs of their public texts, in lower case.
NOTICES = {
    "apache": [
        "spdx-license-identifier apache-2.0", "licensed under the apache license version 2.0", "distributed under the apache license 2.0",
        "licensed under the apache license version 2.0 (the license) you may not use this file except in compliance with the license you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "mit": [
        "spdx-license-identifier mit", "released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software) to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "gpl": [
        "spdx-license-identifier gpl-2.0-only", "spdx-license-identifier gpl-3.0-or-later", "this work is licensed under the gnu general public license version 3", 
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license",
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (at your option) any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see https://www.gnu.org/licenses/",
    ],
    "bsd": [
        "spdx-license-identifier bsd-3-clause", "spdx-license-identifier bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd 3-clause license", "licensed under the new bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "isc": [
        "spdx-license-identifier isc", "released under the isc license", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "zlib": [
        "spdx-license-identifier zlib", "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
    "boost": ["distributed under the boost software license version 1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"],
    "mpl": ["spdx-license-identifier mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https://mozilla.org/mpl/2.0/"],
    "cc": ["licensed under cc by-nd 4.0", "licensed under cc by-nc-sa 4.0", "licensed under cc by-nc-nd 4.0", "spdx-license-identifier cc-by-4.0", "spdx-license-identifier cc-by-sa-4.0", "licensed under cc by-nc 4.0", "licensed under cc by 4.0", "licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "this work is licensed under a creative commons attribution-sharealike 4.0 international license to view a copy of this license visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "reserved": ["all rights reserved", "copyright all rights reserved no part may be reproduced without permission", "no part of this publication may be reproduced stored or transmitted in any form or by any means without the prior written permission of the publisher"],
    "public_domain": ["this work is in the public domain", "released into the public domain", "dedicated to the public domain under cc0 1.0 universal", "this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means"],
    "lgpl": ["released under the gnu lesser general public license", "this library is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or (at your option) any later version", "licensed under the gnu lesser general public license version 2.1", "gnu lesser general public license version 3", "licensed under the lgpl", "gnu library general public license", "spdx-license-identifier lgpl-2.1-or-later", "spdx-license-identifier lgpl-3.0-only"],
    "agpl": ["licensed under the gnu affero general public license", "released under the gnu affero general public license version 3", "it under the terms of the gnu affero general public license as published by the free software foundation", "spdx-license-identifier agpl-3.0-or-later", "licensed under the agpl"],
    "epl": ["licensed under the eclipse public license version 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "spdx-license-identifier epl-2.0"],
    "eupl": ["licensed under the eupl version 1.2", "licensed under the european union public licence", "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl (the licence)", "you may not use this work except in compliance with the licence", "spdx-license-identifier eupl-1.2"],
    "cddl": ["licensed under the common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license (the license)", "this file is subject to the cddl version 1.0", "spdx-license-identifier cddl-1.0"],
    "wtfpl": ["do what the fuck you want to public license", "this program is free software it comes without any warranty to the extent permitted by applicable law you can redistribute it and/or modify it under the terms of the do what the fuck you want to public license", "licensed under the wtfpl", "spdx-license-identifier wtfpl"],
    "unlicense": ["released under the unlicense", "for more information please refer to https://unlicense.org", "spdx-license-identifier unlicense"],
    "artistic": ["released under the artistic license 2.0", "this is free software you can redistribute it and/or modify it under the same terms as the perl 5 programming language", "spdx-license-identifier artistic-2.0"],
}
#: Pairs of these alone say nothing of a licence, so no passage begins with them.
_PLAIN_WORDS = frozenset("a all and any are as at be but by for from if in is it may no not of on or see that the this to under use with without you".split())
_WORD = re.compile(r"[\w./-]*\w")
_GAP = 6
#: Words that deny what follows them in a sentence; _DENIED words before a passage are looked at.
_DENIALS = frozenset("not no never nor neither without cannot don't doesn't isn't aren't won't wasn't weren't didn't".split())
_DENIED = 8
_SAID = re.compile(r"[\w./-]*\w(?:['\u2019]t\b)?|[.!?;:](?=\s|$)")


def denied(before: str) -> bool:
    """Whether a sentence's words so far deny what comes next: "we do not ship software ..."."""
    sentence: list[str] = []
    for m in _SAID.finditer(before.lower().replace("\u2019", "'")):
        sentence = [] if m[0] in ".!?;:" else [*sentence[1 - _DENIED :], m[0]]
    return not _DENIALS.isdisjoint(sentence)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(w: list[str]) -> list[str]:
    return [*w, *map(" ".join, zip(w, w[1:]))]


class Notices:
    def __init__(self, notices: dict[str, list[str]]):
        self.families = [UNKNOWN, *sorted(notices)]
        self.pairs = {f: [frozenset(map(" ".join, zip(w, w[1:]))) for n in notices[f] for w in [words(n)]] for f in notices}
        every = frozenset().union(*(p for ps in self.pairs.values() for p in ps))
        self.every_pair = frozenset(p for p in every if not _PLAIN_WORDS.issuperset(p.split(" ")))
        self.feature = {g: k for k, g in enumerate(sorted({g for ns in notices.values() for n in ns for g in _grams(words(n))}))}
        self.longest = max((len(words(n)) for ns in notices.values() for n in ns), default=0)
        self.first = frozenset(p.split(" ")[0] for p in self.every_pair)

    def passages(self, line: str) -> list[list[str]]:
        """Stretches of words around known pairs, at most _GAP words apart; those that their sentence denies are left out."""
        spans = list(_WORD.finditer(line.lower()))
        w = [m[0] for m in spans]
        at = [i for i in range(len(w) - 1) if w[i] in self.first and f"{w[i]} {w[i + 1]}" in self.every_pair]
        out: list[list[int]] = []
        for i in at:
            if out and i - out[-1][1] <= _GAP:
                out[-1][1] = i
            else:
                out.append([i, i])
        return [w[max(0, a - 1) : b + 3] for a, b in out if not (a and denied(line[: spans[a].start()]))]

    def wrapped(self, lines: list[str], confirm: float) -> Iterator[tuple[int, int, list[str]]]:
        """Stretches that cross line ends and hold enough pairs of some notice: first line, last line, words; few lines first."""
        w, line = [], []
        for k, x in enumerate(lines):
            own = words(x)
            w += own
            line += [k] * len(own)
        at = [i for i in range(len(w) - 1) if w[i] in self.first and f"{w[i]} {w[i + 1]}" in self.every_pair]
        runs: list[list[int]] = []
        for i in at:
            if runs and i - runs[-1][-1] <= _GAP:
                runs[-1].append(i)
            else:
                runs.append([i])
        out = []
        for run in runs:
            if line[run[0]] == line[run[-1] + 1]:
                continue
            for p, a in enumerate(run):
                if p and line[a] == line[run[p - 1]]:
                    continue  # a stretch starts with the first pair of a line
                for q in range(p + 1, len(run)):
                    b = run[q]
                    if b - a > 3 * self.longest:
                        break
                    if q + 1 < len(run) and line[run[q + 1] + 1] == line[b + 1]:
                        continue  # and ends with the last one
                    if line[a] < line[b + 1]:
                        have = {f"{w[i]} {w[i + 1]}" for i in run[p : q + 1]}
                        if any(len(n & have) >= confirm * len(n) for ns in self.pairs.values() for n in ns):
                            out.append((line[a], line[b + 1], w[max(0, a - 1) : b + 3]))
        yield from sorted(out, key=lambda x: x[1] - x[0])

    def known(self, w: list[str]) -> tuple[list[str], float]:
        """The notices' n-grams in a passage, each once, and the share of its words that no notice has."""
        return sorted({g for g in _grams(w) if g in self.feature}), 1 - sum(v in self.feature for v in w) / max(1, len(w))

    def confirmed(self, family: str, w: list[str]) -> float:
        """Largest share of one notice's word pairs found in the passage."""
        have = set(map(" ".join, zip(w, w[1:])))
        return max((len(p & have) / len(p) for p in self.pairs.get(family, [])), default=0.0)


def _practice(lines: list[str], notes: Notices, notices: dict[str, list[str]], rng: np.random.Generator) -> list[tuple[int, list[str], float]]:
    """Notices, whole and in part, with words lost, doubled or swapped for the corpus' words, and the corpus' own lines."""
    rows = []
    common = [w for line in lines for w in words(line)] or ["x"]
    known = sorted(notes.feature)
    odd = lambda most: [common[rng.integers(len(common))] for _ in range(rng.integers(most))]
    for k, family in enumerate(notes.families[1:], 1):
        for n in notices[family]:
            for _ in range(4):
                w = words(n)
                some = int(rng.integers(-(-7 * len(w) // 10), len(w) + 1))
                at = int(rng.integers(len(w) - some + 1))
                w = [v if rng.random() > 0.06 else common[rng.integers(len(common))] for v in w[at : at + some] if rng.random() > 0.05]
                rows.append((k, *notes.known([*odd(3), *w, *odd(4)])))
    for line in lines:
        w = words(line)
        i = rng.integers(max(1, len(w)))
        rows.append((0, *notes.known(w[i : i + rng.integers(3, 20)])))
        rows += [(0, *notes.known(p)) for p in notes.passages(line)]  # hard ones: pairs of a notice, but not a notice
        noise = [common[rng.integers(len(common))] if rng.random() < 0.6 else known[rng.integers(len(known))].split(" ")[0] for _ in range(rng.integers(3, 15))]
        rows.append((0, *notes.known(noise)))
    return rows


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, floor: float):
        self.weights, self.bias, self.floor = weights, bias, floor

    def classify(self, at: list[int], rest: float) -> tuple[int, float]:
        """The likeliest family and its probability, from the places of a passage's n-grams and its share of other words."""
        z = self.weights[:, at].sum(axis=1) + rest * self.weights[:, -1] + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return k, float(p[k])


def fit(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, sample_docs: int = 600, sample_lines: int = 5000, false_rate: float = 0.001) -> Model:
    """Fits on a bounded sample: about ``sample_lines`` lines of about ``sample_docs`` documents, both chosen by hash."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, VectorAssembler

    from corpus_spark.llm.common import written

    step = max(1, docs.count() // sample_docs)
    some = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(step)) == 0)).select("text")
    line = F.explode(F.split("text", "\n")).alias("line")
    some = some.select(line).filter(F.trim("line") != "")
    step = max(1, some.count() // sample_lines)
    some = some.filter(F.pmod(F.xxhash64("line", F.lit(13)), F.lit(step)) == 0)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notes = Notices(notices)
        for pdf in parts:
            for at in range(0, len(pdf), 400):
                lines = [x for x in pdf["line"].iloc[at : at + 400] if not any(notes.confirmed(f, p) >= 0.6 for p in notes.passages(x) for f in notices)]
                rows = _practice(lines, notes, notices, np.random.default_rng(at))
                yield pd.DataFrame({"label": [float(k) for k, _, _ in rows], "grams": [g for _, g, _ in rows], "rest": [r for _, _, r in rows], "held": [i % 5 == 0 for i in range(len(rows))]})

    rows = written(some.repartition(6).mapInPandas(run, "label double, grams array<string>, rest double, held boolean"), "licence-practice")
    notes = Notices(notices)
    n = len(notes.families)
    if rows.select("label").distinct().count() < n:
        return Model(np.zeros((n, len(notes.feature) + 1)), np.r_[1.0, np.zeros(n - 1)], 1.0)
    sparse = CountVectorizerModel.from_vocabulary(list(notes.feature), "grams", "known", minTF=1.0).setBinary(True)
    ready = VectorAssembler(inputCols=["known", "rest"], outputCol="features").transform(sparse.transform(rows))
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(ready.filter("not held").select("label", "features"))
    model = Model(fitted.coefficientMatrix.toArray(), np.array(fitted.interceptVector.toArray()), 0.0)
    best = rows.filter("held and label = 0").select("grams", "rest").toPandas()  # a fifth of twice the sample
    judged = [model.classify([notes.feature[g] for g in grams], rest) for grams, rest in zip(best["grams"], best["rest"])]
    wrong = sorted((p for k, p in judged if k), reverse=True)
    allowed = int(false_rate * len(best))
    model.floor = max(0.5, wrong[allowed] if len(wrong) > allowed else 0.0)
    return model


def scan(docs: DataFrame, model: Model, notices: dict[str, list[str]] = NOTICES, confirm: float = 0.6) -> DataFrame:
    """doc_id, families (sorted), n_passages, best double: what is predicted above the floor and confirmed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, notes = shared.value, Notices(notices)
        # a paragraph without any word pair of a notice has no passage; one search rules most of them out
        gate = re.compile("|".join(sorted({re.escape(w) for w in notes.first}, key=len, reverse=True)))
        known: dict[str, list[tuple[str, float]]] = {}

        def judged(w: list[str]) -> list[tuple[str, float]]:
            grams, rest = notes.known(w)
            k, p = m.classify([notes.feature[g] for g in grams], rest)
            return [(notes.families[k], p)] if k and p >= m.floor and notes.confirmed(notes.families[k], w) >= confirm else []

        def wrapped(lines: list[str], taken: list[tuple[int, str]]) -> Iterator[tuple[str, float]]:
            """Passages over several lines, where none of their family was found in one of these lines."""
            for lo, hi, w in notes.wrapped(lines, confirm):
                for f, p in judged(w):
                    if not any(f == g and lo <= k <= hi for k, g in taken):
                        taken += [(k, f) for k in range(lo, hi + 1)]
                        yield f, p

        for pdf in parts:
            fam, count, best = [], [], []
            for text in pdf["text"]:
                hits: list[tuple[str, float]] = []
                paragraph: list[str] = []
                taken: list[tuple[int, str]] = []
                for line in [*text.split("\n"), ""] if text else ():
                    if not _WORD.search(line):
                        if len(paragraph) > 1 and gate.search(" ".join(paragraph).lower()):
                            hits += wrapped(paragraph, taken)
                        paragraph, taken = [], []
                        continue
                    got = known.get(line)
                    if got is None:
                        got = []
                        if gate.search(line.lower()):
                            for w in notes.passages(line):
                                got += judged(w)
                        if got and len(line) < 200 and len(known) < 10_000:
                            known[line] = got
                    taken += [(len(paragraph), f) for f, _ in got]
                    paragraph.append(line)
                    hits += got
                fam.append(sorted({f for f, _ in hits}))
                count.append(len(hits))
                best.append(round(max((p for _, p in hits), default=0.0), 6))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "families": fam, "n_passages": count, "best": best})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, families array<string>, n_passages bigint, best double")
