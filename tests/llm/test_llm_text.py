import hashlib
from collections import Counter

import numpy as np

from corpus_spark.llm import chat, html_extract, langid, licences, quality
from corpus_spark.llm.common import table
from corpus_spark.llm.queries import vocabulary


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, host string")


def doc(k, text, lang=None, source="s"):
    return (k, text, lang, source, "clash", "clash")


def test_forward_sums_all_segmentations():
    g = langid.lattice(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    prob = rng.random((g.n, 2)) * 0.01
    words = ["the", "über", "日x", "a" * 30]

    def brute(s, k, at=0):
        if at == len(s):
            return 1.0
        total, single = 0.0, False
        for j in range(at + 1, min(len(s), at + g.longest) + 1):
            if s[at:j] in g.piece:
                total += prob[g.piece[s[at:j]], k] * brute(s, k, j)
                single |= j == at + 1
        if not single:
            total += prob[g.n - 1, k] * brute(s, k, at + 1)
        return total

    got = g.log_likelihood(words[:3], prob)
    for i, w in enumerate(words[:3]):
        for k in range(2):
            assert np.isclose(got[i, k], np.log(brute("▁" + w, k)))
    assert np.allclose(g._long(words[3], prob), g.log_likelihood([words[3]], prob)[0])
    assert np.isfinite(g.log_likelihood(["b" * 20_000], prob)).all()


def test_language_identification(spark):
    de, en = "der hund läuft über die straße und ", "the dog runs over the street and "
    rows = [doc(k, (de if k % 2 else en) * 5, "de" if k % 2 else "en") for k in range(60)]
    rows += [doc(100, None), doc(101, "  "), doc(102, "123 !!"), doc(103, en * 3, None), doc(103, de * 3, None), doc(104, "x" * 5000, None)]
    got = langid.identify(docs(spark, rows), vocabulary("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    by = Counter((r["doc_id"], r["lang_pred"]) for r in got)
    assert all(by[(k, "de" if k % 2 else "en")] == 1 for k in range(60))
    assert by[(100, "und")] and by[(101, "und")] and by[(102, "und")] and by[(103, "en")] and by[(103, "de")]
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.identify(docs(spark, [doc(1, "words", None)]), vocabulary("piece_bpe_32k.model")).first()
    assert none["lang_pred"] == "und"
    assert langid.identify(docs(spark, rows).limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_base_measures_against_brute_force():
    rng = np.random.default_rng(3)
    texts = ["", "a", "a b", "a b c a b c", "x\nx\n\ny\nx", "one two #* \x1c z", "日本 語 日本 語 日本 語"] + [" ".join(rng.choice(list("abc"), 30)) for _ in range(20)]
    for t in texts:
        w = t.encode().split()
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in range(3)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in lines
                lines.add(line)
        assert quality.measure(t) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)), t


def test_line_frequency(spark):
    words = [f"w{k}" for k in range(4000)]
    body = lambda k: " ".join(words[60 * k : 60 * k + 60])
    menu = "\n".join(" ".join(f"menu{i}_{j}" for j in range(10)) for i in range(20))
    rows = [doc(k, body(k) + "\nThe  Footer", source="a") for k in range(40)]
    rows += [doc(50 + k, f"own{k}\n" + menu, source="a") for k in range(30)]
    rows += [doc(200 + k, body(1) + " copy", source="b") for k in range(40)]  # copies are documents of their own
    rows += [doc(300, None), doc(301, ""), doc(302, body(5), source=None), doc(0, body(9), source="a")]
    got = {}
    for r in quality.assess(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(r["kept"] for k in range(40) for r in got[k]) and got[3][0]["n_words_left"] == 60
    assert not any(r["kept"] for k in range(30) for r in got[50 + k])
    assert not any(r["kept"] for k in range(40) for r in got[200 + k]) and got[302][0]["kept"]
    dealt = quality.assess(docs(spark, rows), broadcast_rows=0).collect()
    assert sorted(map(str, dealt)) == sorted(str(r) for x in got.values() for r in x)
    assert got[300][0]["base_failed"] and not got[301][0]["kept"] and got[300][0]["n_words"] == 0
    assert quality.assess(docs(spark, rows).limit(0)).count() == 0


CONTROL = ["<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "<\\\\|x", "<", "|im_start|>", "a<|", "\\", "", None, "<|im_end|>\n", "\n", "x" * 5000]


def test_chat_round_trip(spark):
    rows = [(k // 4, k % 4, ["user", "assistant", None, "a\nb%0A%25"][k % 4], CONTROL[k % len(CONTROL)], "clash") for k in range(48)]
    rows += [(None, 1, "user", "u", "c"), (None, None, "assistant", "v", "c"), (99, 0, "assistant", "tie", "c"), (99, 0, "assistant", "tie", "c"), (98, 0, "user<|im_end|>", "y", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chat(df)
    assert chats.filter("not faithful").count() == 0
    got = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chat(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>Head &amp; line</h1><p>First   paragraph of the story, with words.<p>Second <b>bold</b> one &lt;here&gt;.</p></article>
<footer>&copy; example</footer></body></html>"""


def test_html(spark):
    root = html_extract.parse(PAGE)
    nodes, x = html_extract.features(root)
    assert x.shape == (len(nodes), len(html_extract.NAMES))
    keep = html_extract.decode(nodes, np.where([n.tag in ("h1", "p", "b") for n in nodes], 1.0, -1.0))
    assert all(not keep[n.index] or n.parent is None or keep[n.parent.index] for n in nodes)
    text = "Head & line\nFirst paragraph of the story, with words.\nSecond bold one <here>."
    assert "\n".join(html_extract.blocks(root, keep)) == text
    body = "<p>" + "</p><p>".join(f"Sentence number {k} of a longer text, which goes on for a while." for k in range(6)) + "</p>"
    pages = [(k, f"u{k}", PAGE.replace("<p>Second", body + f"<p>Second{k}"), "clash") for k in range(60)]
    pages += [(100, None, None, ""), (101, "u", "", ""), (102, "u", "just words", ""), (103, "u", "<div><p>unclosed " + "word " * 20_000, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    trees = html_extract.fit(df, sample_pages=60)
    got = {r["page_id"]: r for r in html_extract.extract(df, trees).collect()}
    assert len(got) == len(pages) and got[100]["text"] == "" and got[101]["n_chars"] == 0 and got[102]["text"] == "just words"
    for k in range(60):
        assert "Home" not in got[k]["text"] and "Buy" not in got[k]["text"] and "example" not in got[k]["text"] and f"Second{k} bold one <here>." in got[k]["text"]
    assert html_extract.extract(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


def everything(page):
    root = html_extract.parse(page)
    return html_extract.blocks(root, np.ones(len(html_extract.features(root)[0]), dtype=bool))


def test_html_that_ends_anywhere_or_never():
    import time

    began = time.time()
    odd = ["<a " + " ".join(f'x{k}="a' for k in range(1000)), "<a " + " ".join(f'x{k}="v"' for k in range(5000)), "<svg>" * 20_000, "<head>" * 20_000, "<b><p>" * 5000, "<div>" * 5000 + "</x>" * 20_000]
    odd += ["<" * 50_000, "<!" * 50_000, "</" * 50_000, "<a b='" * 20_000, "&" * 50_000, "<a " + "=" * 50_000, "<a " + "/ " * 50_000, "<!--" * 20_000]
    for page in odd:
        everything(page)
    for k in range(len(PAGE)):
        everything(PAGE[:k])
    assert time.time() - began < 20


def test_html_references_and_raw_elements():
    for page, want in (
        ("a &am<b>p;</b>", ["a &amp;"]), ("<svg>x<svg></svg>leak</svg>y", ["y"]), ("<p>a&lt;b &amp;amp; c", ["a<b &amp; c"]), ('<p title="x>y">t</p>', ["t"]), ("<SCRIPT>x</SCRIPT >z", ["z"]),
        ("x < y <p>1 <2</p>", ["x < y", "1 <2"]), ("<title>a</title><p>b<p>c", ["b", "c"]), ("<a href=foo/>k</a>m", ["km"]), ("<p>İ<script>a</script>b", ["İb"]), ("<p a='1' b=\"2\" c=3 d>x<br/>y", ["x y"]),
    ):
        assert everything(page) == want, page


def test_decode_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(40):
        root = html_extract.Node("#root", None)
        nodes = [root]
        for _ in range(int(rng.integers(1, 8))):
            up = nodes[rng.integers(len(nodes))]
            up.children.append(html_extract.Node("p", up))
            up.items += [up.children[-1], "x" * int(rng.integers(0, 4))]
            nodes.append(up.children[-1])
        nodes, _ = html_extract.features(root)
        odds = rng.standard_normal(len(nodes))
        gain = np.array([o * (1 + n.own) if n.own else 0.0 for o, n in zip(odds, nodes)])
        best = 0.0
        for mask in range(1 << len(nodes) - 1):
            keep = [True, *(bool(mask >> k & 1) for k in range(len(nodes) - 1))]
            if all(not keep[i] or keep[n.parent.index] for i, n in enumerate(nodes) if n.parent):
                best = max(best, sum(g for g, k in zip(gain[1:], keep[1:]) if k))
        keep = html_extract.decode(nodes, odds)
        assert np.isclose(gain[1:][keep[1:]].sum(), best)


def test_trees_match_spark(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    df = spark.createDataFrame([(v.tolist(), float(v[0] + v[1] * v[2] > 0.7)) for v in x], "x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(df)
    odds = html_extract.Trees(model.toDebugString).log_odds(x)
    want = [r["prediction"] for r in model.transform(df).collect()]
    assert [float(o > 0) for o in odds] == want


def test_licences(spark):
    prose = [doc(k, "\n".join(" ".join(f"w{k}_{i}_{j}" for j in range(12)) for i in range(6))) for k in range(300)]
    rows = prose + [doc(1000, "Text here.\nLicensed under the Apache License, Version 2.0.\nmore"), doc(1001, "Released under the MIT License."), doc(1002, "all of the license and more of the work"), doc(1003, None), doc(1004, ""), doc(1005, "so " * 20_000 + "This work is licensed under the GNU General Public License, version 3. end")]
    df = docs(spark, rows)
    got = {r["doc_id"]: r for r in licences.scan(df, licences.fit(df)).collect()}
    assert got[1000]["families"] == ["apache"] and got[1001]["families"] == ["mit"] and got[1005]["families"] == ["gpl"]
    assert all(got[k]["families"] == [] for k in (0, 1, 1002, 1003, 1004)) and len(got) == len(rows)
    assert licences.scan(df.limit(0), licences.fit(df.limit(0))).count() == 0


GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""


def test_wrapped_licences(spark):
    prose = [doc(k, "\n".join(" ".join(f"w{k}_{i}_{j}" for j in range(12)) for i in range(6))) for k in range(300)]
    wrapped = "Some words before. Licensed under the\nApache License, Version 2.0 (the License)"
    rows = prose + [doc(1000, GPL), doc(1001, wrapped), doc(1002, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), doc(1003, wrapped.replace("\n", "\n\n")), doc(1004, wrapped + ".\n" + GPL[6:])]
    rows += [doc(1005, "word\n" * 5000 + "Permission is\nhereby granted\nfree of\ncharge to any\nperson obtaining a copy\nof this software\n")]
    df = docs(spark, rows)
    got = {r["doc_id"]: (r["families"], r["n_passages"]) for r in licences.scan(df, licences.fit(df)).collect()}
    assert got[1000] == (["gpl"], 1) and got[1001] == (["apache"], 1) and got[1002] == (["apache", "mit"], 2)
    assert got[1003] == ([], 0) and got[1004] == (["apache", "gpl"], 2) and got[1005] == (["mit"], 1)
    assert all(got[k] == ([], 0) for k in range(300))


def test_scores_of_unseen_letters(spark):
    rng = np.random.default_rng(1)
    words = [("en", "the dog runs over the street and talks"), ("de", "der hund läuft über die straße und redet")]
    rows = [doc(k, " ".join(rng.choice(words[k % 2][1].split(), 900)), words[k % 2][0]) for k in range(300)]
    odd = ["日" * 40, "日" * 40 + " the dog runs over the street", "日" * 41 + " der hund", "\u0378" * 40, "x" * 40]
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, rows + [doc(1000 + k, t) for k, t in enumerate(odd)]), vocabulary("piece_bpe_32k.model")).collect()}
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got.values())
    assert got[1001]["lang_pred"] == "en" and got[1002]["lang_pred"] == "de"


def test_held_out_accuracy(spark):
    known = table(spark, "/root/testdata/sf0.01", "documents").filter("lang is not null")
    got = langid.identify(known, vocabulary("piece_bpe_32k.model")).join(known.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    asked = [r for r in got if r["lang_pred"] != "und"]
    assert len(asked) > 100 and sum(r["lang_pred"] == r["lang"] for r in asked) >= 0.95 * len(asked)


def test_paragraphs_of_licence_texts(spark):
    rows = [doc(k, "\n".join(" ".join(f"w{k}_{i}_{j}" for j in range(12)) for i in range(6))) for k in range(300)]
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    apache = "// Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an \"AS IS\" BASIS,\n// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n// See the License for the specific language governing permissions and\n// limitations under the License."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    rows += [doc(1000, isc), doc(1001, apache), doc(1002, mit + "\n\n" + isc), doc(1003, "the use of the software in the case of any claim by the author of this book, without any of the rights to copy it")]
    df = docs(spark, rows)
    got = {r["doc_id"]: r["families"] for r in licences.scan(df, licences.fit(df)).collect()}
    assert got[1000] == ["isc"] and got[1001] == ["apache"] and got[1002] == ["isc", "mit"] and got[1003] == []
    assert not any(got[k] for k in range(300))


def test_repeated_texts_of_hosts(spark):
    pages = [("a.org", f"<p>Same words on all.</p><p>Own words of page number {k}.</p>") for k in range(10)] + [("c.org", "<p>Copies.</p><p>of one page</p>")] * 10 + [("b.org", f"<p>Own {k}.</p>") for k in range(10)] + [(None, "<p>Same words on all.</p>")] * 9
    found = html_extract.repeated_texts(spark.createDataFrame(pages, "host string, html string"))
    assert {k: len(v) for k, v in found.items()} == {"a.org": 1}


def test_languages_without_blanks(spark):
    de, en = "derhundläuftüberdiestraßeund", "thedogrunsoverthestreetand"
    rows = [doc(k, (de if k % 2 else en)[k % 7 :] + (de if k % 2 else en) * 5, "de" if k % 2 else "en") for k in range(60)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(spark, rows), vocabulary("piece_bpe_32k.model")).collect()}
    assert got == {k: "de" if k % 2 else "en" for k in range(60)}
    assert sum(len(langid._spelled(x)) for x in langid._stretches("x" * 100)) == 101
