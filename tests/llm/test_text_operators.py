import hashlib
import math
import random
import re
import time
import zlib

import pytest

from graphloom.llm import ftrl_toxicity as FT
from graphloom.llm import license_scan as LS
from graphloom.llm import tag_paths as TP
from graphloom.llm import warc as WA


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain   text,\n no tags", "plain text, no tags"),
        ("<article><h1>A &amp; B</h1><p><b>One,\t two.<br><p>Three&nbsp;four.</article><footer>&copy; x, y.</footer>", "A & B\nOne, two.\nThree four."),
        ("<body><nav><a href=/>Home, now.</a></nav><main><p>First, para. Of text.</p><p>Ok.</p></main><aside>Ad, here.</aside></body>", "First, para. Of text.\nOk."),
        ('<div id="c"><p>Long content, really. Yes.</p><div class="comments"><p>I disagree, strongly. With it.</p></div></div>', "Long content, really. Yes."),
        ('<article><p>Body, text. Here.</p><script>var t="</p>"; if (a<b) {}</script><style>p{}</style><form>Your name, please.</form></article>', "Body, text. Here."),
        ("<article><p>cut off, in the mid", "cut off, in the mid"),
        ("<ul><li><a>one</a><li><a>two</a></ul><article><p>a &lt;b&gt; c, d.</p><!-- no, no. --></article>", "a <b> c, d."),
    ],
)
def test_pages(page, text):
    assert TP.extract(page) == text


def test_content_beside_the_largest_element_stays():
    para = "This is a long sentence of the article, with commas, and it says something; it goes on for a while. "
    side = "<nav><a href=x>Home</a></nav>"
    page = f"<body>{side}<div class=post><h1>The headline</h1><p>{para * 2}</p><div class=entry>{f'<p>{para * 3}</p>' * 4}</div></div><footer>Imprint</footer></body>"
    got = TP.extract(page)
    assert got.startswith("The headline\n" + (para * 2).strip()) and got.count("This is a long") == 14
    assert "Home" not in got and "Imprint" not in got
    halves = f"<body>{side}<div><section>{f'<p>{para * 3}</p>' * 6}</section><section>{f'<p>{para * 3}</p>' * 2}</section></div></body>"
    assert TP.extract(halves).count("This is a long") == 24


def generated_page(r, sentence, layout):
    """A page of random shape and its article's blocks."""
    blocks, article = [], []
    add = lambda tag, t: (blocks.append(t), article.append(f"<{tag}>{t}</{tag}>"))
    add("h1", sentence(4)[:-1])
    for _ in range(r.randint(3, 9)):
        kind = r.random()
        if kind < 0.6:
            add("p", " ".join(sentence(r.randint(6, 14)) for _ in range(r.randint(1, 4))))
        elif kind < 0.75:
            add("h2", sentence(3)[:-1])
            add("p", " ".join(sentence(9) for _ in range(2)))
        else:
            article.append("<ul>")
            for _ in range(r.randint(2, 5)):
                add("li", sentence(r.randint(2, 7)))
            article.append("</ul>")
    links = "".join(f"<li><a href=x>{sentence(1)[:-1]}</a></li>" for _ in range(6))
    notes = "".join(f"<p>{sentence(8)} {sentence(5)}</p>" for _ in range(r.randint(1, 6)))
    body = "".join(article)
    body = {"article": f"<article>{body}</article>", "div": f"<div class='post with-sidebar'>{body}</div>", "sections": f"<div class=wrap><section>{body}</section></div>"}[layout]
    page = (
        f"<html><head><title>{sentence(3)}</title></head><body><header><p>{sentence(7)}</p></header><nav><ul>{links}</ul></nav><div class='ad-slot'>{sentence(9)}</div>{body}"
        f"<section id=comments>{notes}</section><aside><p>{sentence(12)}</p></aside><form><p>{sentence(6)}</p></form><div class=cookie-notice><p>{sentence(11)}</p></div><footer>{sentence(8)}</footer></body></html>"
    )
    return page, "\n".join(blocks)


def test_generated_pages_and_the_threshold(prose):
    r = random.Random(4)
    n = iter(range(10**6))
    sentence = lambda k: " ".join(prose(k, next(n))).capitalize().replace(" ", ", ", 1) + "."
    pages = [generated_page(r, sentence, layout) for layout in ("article", "div", "sections") for _ in range(40)]
    assert [TP.extract(page) for page, _ in pages] == [text for _, text in pages]
    # the threshold decides: nothing reaches more than the best path, and at 0 the furniture comes too
    assert all(TP.extract(page, TP.PathParams(cut=1.01)) == "" for page, _ in pages)
    assert all(len(TP.extract(page, TP.PathParams(cut=0.0))) > len(text) for page, text in pages)
    cells = "<article><p>" + " ".join(sentence(12) for _ in range(4)) + "</p><table>" + "<tr><td>1</td><td>2</td><td>3</td></tr>" * 60 + "</table></article>"
    assert TP.extract(cells).endswith("\n3") and not TP.extract(cells, TP.PathParams(cut=0.6)).endswith("\n3")


def test_path_scores_match_their_definition():
    r, p = random.Random(8), TP.PathParams()
    nodes = [(r.randrange(5), r.choice((0, 1, 8, 60, 400)), r.randrange(6)) for _ in range(60)]
    g = lambda d: math.exp(-d * d / (2 * p.sigma**2)) if abs(d) <= p.radius else 0.0
    fused = {}
    for k in {x[0] for x in nodes}:
        own = [x for x in nodes if x[0] == k]
        fused[k] = math.log(1 + sum(x[1] for x in own) / len(own)) * (1 + math.log(1 + sum(x[2] for x in own) / len(own)))
    smooth = [sum(g(i - j) * fused[y[0]] for j, y in enumerate(nodes)) / sum(g(i - j) for j in range(len(nodes))) for i in range(len(nodes))]
    got = TP.path_scores(nodes, p)
    for k in fused:
        own = [s for s, x in zip(smooth, nodes, strict=True) if x[0] == k]
        assert abs(got[k] - min(sum(own) / len(own), p.lift * fused[k])) < 1e-9


@pytest.mark.parametrize("wrapper", ['class="layout with-sidebar"', 'class="content no-sidebar"', 'class="legal-opinion"', 'id="related-work"', 'title="the hidden cost of trade"', "class=related"])
def test_wrappers_named_like_furniture(wrapper):
    own = "<h1>The case</h1><p>A long text, with points. And more of it, yes.</p><p>Second text, with more points. It ends.</p>"
    want = "The case\nA long text, with points. And more of it, yes.\nSecond text, with more points. It ends."
    for inner in (own, f"<article>{own}</article>"):
        assert TP.extract(f'<body><div {wrapper}>{inner}<div class="comments"><p>No, not at all. I say.</p></div></div></body>') == want
    assert TP.extract("<body><div hidden><p>Not shown, at all. Never.</p></div><p>Shown, of course. Yes.</p></body>") == "Shown, of course. Yes."


def test_an_articles_own_header_and_open_ends():
    page = "<article><header><h1>Head</h1><p>A standfirst, of some length.</p></header><p>Body text, which goes on. And on.</p></article>"
    assert TP.extract(page) == "Head\nA standfirst, of some length.\nBody text, which goes on. And on."
    assert TP.extract("<p>Text, so far. Yes.</p><!-- open, end. ") == "Text, so far. Yes."
    assert TP.extract("<p>1 < 2, or so. And 3 <") == "1 < 2, or so. And 3 <"


def test_long_and_deep_pages_take_linear_time():
    t = time.process_time()
    for page in ("<b>x" * 60_000 + "</i>" * 60_000, "<div>x" * 60_000, "<li><ul>" + "<b>" * 60_000 + "<li></li>" * 60_000, "<a <b " * 60_000):
        TP.extract(page)
    assert time.process_time() - t < 20


def test_page_table(spark):
    rows = [(1, "u", "<p>a, b.</p>", "x"), (None, None, None, "y"), (1, "u", "<p>a, b.</p>", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, TP.extract_pages(d).collect()), key=str)
    assert got == sorted([(1, "u", "a, b.", 5), (None, None, "", 0), (1, "u", "a, b.", 5)], key=str)
    assert TP.extract_pages(d.limit(0)).count() == 0
    assert TP.extract("<article><p>" + "long text, here. " * 50_000 + "</p></article>") == ("long text, here. " * 50_000).strip()


def test_license_labels():
    assert len(LS.rules()) > 300
    x = LS.scan("x Licensed under the Apache License, Version 2.0.")
    assert x["base"] == [(4, "apache-2")] and {f[2] for f in x["found"]} == {"apache-2"} and 0.9 < x["score"] <= 1
    assert {f[2] for f in LS.scan("This work is licensed under the GNU General Public License, version 3.")["found"]} == {"gpl-3"}
    # the narrower name lies inside the wider one
    assert {f[2] for f in LS.scan("released under CC BY-NC-SA 4.0")["found"]} == {"cc-by-nc-sa"}
    assert LS.scan("released under CC BY-NC-SA 4.0")["base"] == [(2, "cc-by-nc")]
    assert LS.scan("mit und apache")["found"] == [] and LS.scan("Mit.")["score"] == 0
    assert {f[2] for f in LS.scan("Distributed under the terms of the Mozilla Public License, v. 2.0")["found"]} == {"mpl-2"}


def scan_all(text):
    """Every rule on every text, without gates and keywords, and suppression pair by pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in LS.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    line = " ".join(words)
    found = sorted(((m.start(), m.end(), r) for r in LS.rules() for m in r.pattern.finditer(line)), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
    kept = []
    for s, e, r in found:
        if not any(a <= s and e <= b or (a < e and s < b and k.priority > r.priority) for a, b, k in kept):
            kept.append((s, e, r))
    return len(words), sorted(base), sorted((line.count(" ", 0, s), line.count(" ", 0, e) + 1, r.label, r.kind) for s, e, r in kept)


def test_license_scan_matches_brute_force(prose):
    r = random.Random(9)
    cited = ["Apache License, Version 2.0", "the MIT License", "GNU General Public License v3 or later", "LGPL 2.1", "CC BY-NC-SA 4.0", "CC-BY-NC", "BSD-3-Clause", "MPL 2.0", "GNU Affero General Public License"]
    around = ["Licensed under {}.", "released under the terms of the {} license", "License: {}", "SPDX-License-Identifier: {}", "This work is licensed under {}", "{} licence", "see {}", "under the {} Apache License version 2"]
    own = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|\?|\{[^}]*\}", r"\1", x[5]) for x in LS.SIGNATURES]
    texts = [None, "", "ÀÉ mit", "under the mit license " * 3]
    for i in range(400):
        parts = [" ".join(prose(r.randint(0, 6), 40 * i + k)) for k in range(4)]
        for k in range(3):
            parts.insert(2 * k + 1, r.choice(own) if r.random() < 0.4 else r.choice(around).format(r.choice(cited)))
        texts.append(r.choice([" ", "\n", " - "]).join(parts))
    seen = set()
    for t in texts:
        got = LS.scan(t)
        assert (got["n_words"], sorted(got["base"]), sorted(x[:4] for x in got["found"])) == scan_all(t), t
        seen |= {x[2] for x in got["found"]}
    assert len(seen) > 45
    assert len({x[:3] + x[3:] for x in LS.SIGNATURES}) == len(LS.SIGNATURES) > 110


def test_long_texts_dense_with_licenses_take_linear_time():
    t = time.process_time()
    got = LS.scan("This file is released under the terms of the MIT License. Licensed under the Apache License, Version 2.0. " * 12_000)
    assert time.process_time() - t < 40 and len(got["base"]) == 12_000


def test_license_phrases_broken_by_line_ends_and_punctuation():
    for sep in (" ", "\n", "  ", "-", ", "):
        assert {f[2] for f in LS.scan(f"All rights{sep}reserved")["found"]} == {"all-rights-reserved"}
        assert {f[2] for f in LS.scan(f"It is released into the public{sep}domain.")["found"]} == {"public-domain"}


def test_license_table(make):
    t = [None, "", "The MIT License under the mit license. Under the MIT License", "underthe mit license", "x " * 50_000 + "cc by nc"]
    got = {r["doc_id"]: r for r in LS.scan_licenses(make(t, ids=[None, 1, 2, 3, 4])).collect()}
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (2, 3, 7, "mit")
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["labels"]) == (0, None, "mit")
    assert (got[4]["n_words"], got[4]["first_word"], got[4]["base_labels"]) == (50_003, 50_000, "cc-by-nc")
    assert (got[None]["n_words"], got[None]["score"], got[None]["labels"]) == (0, 0.0, "")
    assert LS.scan_licenses(make([])).count() == 0


def test_toxicity_learns_and_holds_out(spark, make, prose):
    texts, y = [], []
    for i in range(700):
        w = prose(40, 5000 + i)
        bad = i % 4 == 0
        if bad:
            w[3], w[20] = "vileword", "nastyterm"
        texts.append(" ".join(w)), y.append(int(bad))
    labels = spark.createDataFrame([(i, 0, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    docs = make([*texts, None, "", "vileword nastyterm " * 9000], ids=[*range(700), None, 701, 702])
    got = {r["doc_id"]: r for r in FT.fit_and_score(docs, labels).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(700) if got[i]["held_out"]] == held
    assert sum(got[i]["predicted"] == y[i] for i in held) / len(held) > 0.95
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())
    assert got[701]["predicted"] == 0 and got[None]["held_out"]


def test_conflicting_labels_count_as_toxic(spark, make, prose):
    docs = make([" ".join(prose(30, i)) for i in range(60)] + ["other text"], ids=[*range(60), 3])
    rows = [(i, 0, i % 2) for i in range(60)] + [(i, 0, 1 - i % 2) for i in range(0, 60, 3)] + [(None, 0, 1), (5, 0, None)]
    p = FT.FtrlParams()
    seen = []
    for order in (rows, rows[::-1]):
        labels = spark.createDataFrame(order, "doc_id long, quality int, toxic int").repartition(3)
        seen.append(FT.training_rows(docs, labels, "doc_id", "text", "toxic", p))
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert sum(y for _, y in seen[0]) == sum(i % 2 or i % 3 == 0 for i in train) + (3 in train)
    assert [(f.tolist(), y) for f, y in seen[0]] == [(f.tolist(), y) for f, y in seen[1]]


def test_toxicity_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = FT.fit_and_score(make(["a b", None]), none).collect()
    assert len(got) == 2 and {r["score"] for r in got} == {0.5}
    assert FT.fit_and_score(make([]), none).count() == 0


PAGES = "page_id long, url string, html string, payload string"


def pages(spark):
    big, other = "<p>big</p>" * 200, "ß" * 600
    rows = [(1, "http://a/1", big, "z"), (5, " http://a/5?x=1&y=ü \r\n", big, "z"), (9, None, big, "z"), (2, "u", other, ""), (3, "u", other, ""), (4, "u", "small", ""), (6, "u", "small", ""), (7, "u", None, ""), (8, "u", "", ""), (None, "u", big, "")]
    return spark.createDataFrame(rows, PAGES), rows


def test_warc_round_trip(spark, tmp_path):
    d, rows = pages(spark)
    got = {r["page_id"]: r for r in WA.round_trip(d, path=f"file://{tmp_path}/w").collect()}
    assert len(got) == len(rows)
    lead = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            lead[h] = max(i, lead.get(h, i))
    for i, _, h, _ in rows:
        b, r = (h or "").encode(), got[i]
        revisit = len(b) >= 1000 and i != lead[h]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
        assert r["target_uri"] == next(u for j, u, *_ in rows if j == i)
        assert (r["record_type"], r["refers_to"]) == (("revisit", lead[h]) if revisit else ("response", None))
    full = {r["page_id"]: r["payload"] for r in WA.read_warc(spark, f"file://{tmp_path}/w").filter("record_type = 'response'").collect()}
    assert all(bytes(full[i]) == (h or "").encode() for i, _, h, _ in rows if i in full) and set(full) == {9, 3, 4, 6, 7, 8}


def test_warc_predicates_reach_the_reader(spark, tmp_path):
    d, _ = pages(spark)
    WA.write_warc(WA.archive_records(d), f"{tmp_path}/w")
    q = WA.read_warc(spark, f"{tmp_path}/w", payload=False).filter("record_type = 'response' AND payload_bytes > 1000 AND page_id > 3")
    assert [r["page_id"] for r in q.collect()] == [9]
    reader = WA.WarcReader({"path": f"{tmp_path}/w"})
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("target_uri",), "a")]))
    assert [type(f) for f in left] == [StringContains] and reader.tests == [("record_type", "eq", "revisit")]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["page_id"] for r in rows} == {1, 5, 2, None} and all(r["payload"] is None for r in rows)
    assert WA.read_warc(spark, f"{tmp_path}/none").count() == 0


def test_foreign_members_without_length_are_read(tmp_path):
    import gzip

    recs = [WA.encode_record(i, "response", "u", None, hashlib.sha1(b"x" * n).hexdigest(), n, b"x" * n) for i, n in enumerate((0, 10, 400_000))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    reader = WA.WarcReader({"path": str(tmp_path), "payload": "true"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["page_id"], len(r["payload"])) for r in rows] == [(0, 0), (1, 10), (2, 400_000)]


def test_empty_page_table(spark, tmp_path):
    d, _ = pages(spark)
    assert WA.round_trip(d.limit(0), path=f"file://{tmp_path}/w").count() == 0
