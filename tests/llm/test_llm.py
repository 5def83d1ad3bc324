"""The corpus operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import components, decontaminate, embedding_dedup, html_extract, license_scan, minhash_dedup, packing, quality, sharding, token_counts, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None, "x"), (2, "", "x"), (3, "  \n ", "x"), (3, "same id", "x"), (4, "a b c d e f", "x"), (5, "a b c d e f", "x"), (None, "no id here", "x"), (6, "ünï Σς 漢字 \x1c x " * 400, "x"), (7, "word " * 30000, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns with names that operators use inside.
    return spark.createDataFrame([(*r, 1, 2, "k") for r in ODD], "doc_id long, text string, source string, size int, n long, key string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_token_counts(odd, none):
    whole = token_counts._counter(BYTE).whole
    got = token_counts.count_tokens(odd, BYTE).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(whole.encode(t or "", add_special_tokens=False)) for _, t, _ in ODD)
    assert token_counts.count_tokens(none, BYTE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é'sßΣ\n\t 1!<|endoftext>漢", max_size=120))
def test_token_windows(text):
    small, whole = token_counts.Counter(BYTE, window=24, overlap=4), token_counts._counter(BYTE).whole
    assert small.count(text) == len(whole.encode(text, add_special_tokens=False))
    encoder = packing._encoder(WORD)
    assert encoder.encode(text) == encoder.ids.whole_ids(text)


def test_packing(spark, odd, none):
    got = packing.pack(odd, WORD, size=64, open_windows=3).toPandas()
    encoder, end = packing._encoder(WORD), (2).to_bytes(4, "little")
    texts = {d: t for d, t, _ in ODD if d not in (3, None)}
    for d, t in texts.items():
        ids, at = encoder.ids.whole_ids(t or "") + end, 0
        for r in got[got.doc_id == d].sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
    lengths = got.groupby("sequence_id").length.sum()
    assert lengths.max() == 64 and all(n & (n - 1) == 0 for n in lengths)
    assert packing.pack(none, WORD).count() == 0


def test_ids_are_held_once():
    """Workers keep the memos of packing, which add up beside the executor's heap: no word is held as unit and as piece."""
    r, ids = random.Random(8), packing.Encoder(WORD).ids
    words = ["".join(r.choices("abcdefgh", k=7)) for _ in range(300)]
    text = " ".join([*words, *(w + "," for w in words), "(it's)", "3.14", "\x7f", "É,ß", "İx", "<|endoftext|>,", "word" * 30])
    assert b"".join(ids.look_up(text.split())) == ids.whole_ids(text)
    assert set(words) <= {*ids.units, *ids.units.old} and not set(words) & {*ids.pieces, *ids.pieces.old}
    assert 2 * (ids.units.half + ids.pieces.half) <= 600_000


def test_license(odd, none, spark):
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License.\nAll rights reserved. CC-BY"), (2, "mit der zeit"), (3, "the license released under mit")], "doc_id long, text string")
    a, b, c = license_scan.scan(docs).orderBy("doc_id").collect()
    assert (a.n_base, a.first_word, a.last_word, a.base_labels, a.labels, a.score) == (2, 6, 9, "cc-by,reserved", "cc-by,mit,reserved", 1.0)
    assert (b.labels, b.score, b.first_word) == ("", 0.0, None) and (c.labels, c.score) == ("mit", 1.0)
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(none).count() == 0


WRAPPED = {
    "bsd": "before\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
    "gpl-notice": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided",
    "mit-notice": "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the",
    "mpl-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy",
}


@pytest.mark.parametrize("before", [0, 31, 32, 40, 63, 200])
def test_license_wrapped(spark, before):
    # Also where windows begin and end inside the notice, and where words are far apart.
    labels = [*WRAPPED, ""]
    texts = ["filler word\n" * before + text + "\nend" * before for text in WRAPPED.values()]
    texts.append("released\n" + "filler\n" * 70 + "under the\n" + "filler\n" * 70 + "MIT License")
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [label in r.labels.split(",") for r, label in zip(rows, labels, strict=True)] == [True] * len(labels)
    assert (rows[-1].labels, rows[-1].score) == ("", 0.0)


def brute_components(texts: dict, percent: int):
    sets = {i: minhash_dedup.shingle_set(t, 5) for i, t in texts.items()}
    best = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                best[a] = best[b] = min(best[a], best[b])
    return best


def test_minhash(spark, odd, none):
    r, texts = random.Random(3), {}
    for base in range(6):
        words = [f"w{r.randrange(500)}" for _ in range(120)]
        for k in range(12):
            own = list(words)
            for _ in range(r.randrange(4)):
                own[r.randrange(120)] = "edit"
            texts[base * 12 + k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(docs, 85).collect()}
    assert got == brute_components(texts, 85)
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {(x.doc_id, x.component_id) for x in rows if x.doc_id in (4, 5)} == {(4, 4), (5, 4)}
    assert all(x.kept for x in rows if x.doc_id in (1, 2, None)) and minhash_dedup.near_duplicates(none).count() == 0


def test_minhash_needs_few_stages(spark):
    """Each stage costs the driver memory, whatever the data: copies of one text and near copies in several clusters."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words, f"x{k}"]) for k in range(8)] + [" ".join(words)] * 3 + [" ".join(reversed(words)), "  ".join(reversed(words)), "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(docs, 85).collect()}
    assert got == dict.fromkeys(range(11), 0) | {11: 11, 12: 11, 13: 13}
    assert jobs() - before <= 90


def test_bit_set_keeps_what_is_wanted(spark):
    keys = spark.range(0, 3000, 3).selectExpr("xxhash64(id) as key")
    rows = spark.range(30_000).selectExpr("id", "xxhash64(id) as key")
    held, may = minhash_dedup._may_hold(keys)
    kept = {r.id for r in rows.join(held, may, "left_semi").collect()}
    assert kept >= set(range(0, 3000, 3)) and len(kept) < 3000
    assert {r.id for r in rows.join(held, may, "left_anti").collect()} == set(range(30_000)) - kept
    assert rows.join(*minhash_dedup._may_hold(keys.limit(0)), "left_semi").count() == 0


@pytest.mark.parametrize("one_task", [2_000_000, -1])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    r = random.Random(5)
    edges = [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(50)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (100, 160), (1 << 62, 5)]
    best = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x.id for x in got}) and {x.id: x.component for x in got} == {k: v for k, v in best.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_are_counted_by_one_split(spark):
    """Extracting every word by the pattern took two fifths of the query."""
    texts = [None, "", " ", ",", "a", ",a", "a,", ",a,", "a b", "..a--B ..", "é,ß漢 x\n\n1", "\x00a\x7fb\x80c", "w " * 3000, "ſK İ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontaminate.contaminated(docs, spark.createDataFrame([(1, "nothing of this")], "item_id long, text string"))
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = {k: len(re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_words for r in out.collect()} == want


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 5, 70, 3000):
        s = minhash_dedup.sketch(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64), 174)
        assert s.max() < np.uint64(0xFFFFFFFFFFFFFFFF)


def test_quality_learns_and_covers_the_whole_text():
    r = random.Random(1)
    good = [" ".join(r.choice(["the", "river", "of", "stone", "and", "light"]) for _ in range(80)) for _ in range(60)]
    poor = [" ".join(r.choice(["zz###", "qq***"]) for _ in range(80)) for _ in range(60)]
    net = quality.fit([(t, 1) for t in good] + [(t, 0) for t in poor], epochs=6)
    p = quality.predict(net, [t.encode() for t in good + poor] + [b""])
    assert p[:60].min() > p[60:120].max() and 0 <= p[120] <= 1
    text = bytes(range(1, 256)) * 9
    assert b"".join(c.tobytes()[: quality.STEP] for c in quality.chunks(text))[: len(text)] in (text, text[: len(text)])
    spoiled = good[0].encode() * 40 + poor[0].encode() * 40
    assert quality.predict(net, [spoiled])[0] < quality.predict(net, [good[0].encode() * 80])[0]


def plain_score(net, text):
    """The network chunk by chunk and filter by filter, without batches."""
    size, step, width = quality.CHUNK, quality.STEP, quality.WIDTH
    acts, at = [], 0
    while True:
        chunk = text[at : at + size].ljust(size, b"\0")
        best = np.full(quality.FILTERS, -np.inf)
        for k in range(0, size - width + 1, quality.STRIDE):
            best = np.maximum(best, np.concatenate([net.embed[c] for c in chunk[k : k + width]]).astype(float) @ net.conv)
        acts.append(np.maximum(best + net.bias, 0))
        at += step
        if at + size - step >= len(text):
            break
    feats = np.concatenate([np.max(acts, 0), np.mean(acts, 0), np.min(acts, 0), [np.log1p(len(text))]])
    hidden = np.maximum((feats - net.shift) / net.scale @ net.dense + net.dense_bias, 0)
    return 1 / (1 + np.exp(-(hidden @ net.out + net.out_bias[0])))


def test_quality_against_a_plain_network(odd):
    r = random.Random(2)
    net = quality.fit([(" ".join(r.choice(["the", "of", "river"]) for _ in range(60)), 1) for _ in range(40)] + [("zz## " * r.randrange(20, 60), 0) for _ in range(40)], epochs=2)
    texts = [b"", b"a", bytes(r.randrange(256) for _ in range(383)), b"x y " * 96, b"x y " * 97, "\u00fc\u6f22 river ".encode() * 200]
    assert np.allclose(quality.predict(net, texts), [plain_score(net, t) for t in texts], atol=1e-4)
    got = {r.doc_id: r.score for r in quality.score(odd, net).collect() if r.doc_id in (1, 4, 6)}
    want = {d: plain_score(net, (t or "").encode()) for d, t, _ in ODD if d in (1, 4, 6)}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-4 for d in got)


def test_training_tables(spark):
    r = random.Random(5)
    word = lambda: r.choice("river stone light and of the".split())
    rows = [(k, " ".join(word() for _ in range(30)) + (" you idiot you idiot" if k % 4 == 0 else "")) for k in range(200)]
    # Labels without a document or with a text beyond the bound do not use up the sample; null and clashing labels count as told.
    rows += [(900, "word " * 20_000), (None, "no id"), (901, None), (5, "you idiot again"), (5, "you idiot again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, y int")
    labels = [(k, int(k % 4 == 0), int(k % 4 != 0), 9) for k in range(200)] + [(k, 1, 1, 9) for k in range(1000, 9000)] + [(900, 1, 1, 9), (None, 1, 1, 9), (7, None, None, 9), (8, 0, 0, 9)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text int")
    for module in (toxicity, quality):
        assert module.train(docs, labels.limit(0)) is not None and module.train(docs.limit(0), labels) is not None
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(got[k] == int(k % 4 == 0) for k in range(200) if k != 5)
    from inkstrata.llm.common import labelled_sample
    sample = labelled_sample(docs, labels, "toxic", labels.doc_id.isNotNull(), 150, 1 << 16)
    assert sample.count() == 150 and labelled_sample(docs, labels, "toxic", labels.doc_id.isNotNull(), 10_000, 1 << 16).count() == 200


def naive_hits(model, text):
    """Every term and every exception looked for at every place."""
    inside = set()
    for phrase in model.exceptions:
        for k in range(len(text) - len(phrase) + 1):
            end = k + len(phrase)
            if text[k:end] == phrase and not (k and text[k - 1].isalpha()) and not (end < len(text) and text[end].isalpha()):
                inside.update(range(k, end))
    best = {}
    for whole, terms in ((True, model.words), (False, model.stems)):
        for term, weight in terms.items():
            for k in range(len(text) - len(term) + 1):
                end = k + len(term)
                if text[k:end] == term and not (k and text[k - 1].isalpha()) and not (whole and end < len(text) and text[end].isalpha()) and k not in inside:
                    best[k] = max(weight, best.get(k, weight))
    return sum(best.values()), len(best)


def test_toxicity_against_a_naive_scan():
    r = random.Random(9)
    model = toxicity.Model({"idiot": 3.0, "car": 1.0, "clown": 2.0, "id": 0.5}, {"idio": 1.5, "clow": 4.0, "car": 0.25}, ["clown car", "car idiot", "the idiot clown"])
    for _ in range(400):
        text = "".join(r.choice(["idiot", "idiotic", "clown", "car", "cars", " ", " ", "-", "the", "id", "x"]) for _ in range(r.randrange(30)))
        got, want = model.hits(text), naive_hits(model, text)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9, text


@pytest.mark.parametrize("text", ["you idiot", "1d10t", "!d!ot", "\u00efdiot", "idi\u00f8t", "st\u00fcpid", "\u0456d\u0456\u043et", "\uff29\uff24\uff29\uff2f\uff34", "moron$", "idi\u0301ot", "you (1d!0t!)"])
def test_toxicity_folding(text):
    assert toxicity.fit([]).hits(toxicity.fold(text))[1] == 1


def test_toxicity_of_many_exceptions_in_linear_time():
    import time

    model, began = toxicity.fit([]), time.time()
    assert model.hits(toxicity.fold("clown car idiot " * 40_000))[1] == 40_000 and time.time() - began < 5


def test_scorers_on_odd_rows(odd, none):
    net, model = quality.fit([]), toxicity.fit([])
    for table, n in ((odd, len(ODD)), (none, 0)):
        assert quality.score(table, net).count() == n and toxicity.score(table, model).count() == n


def test_toxicity():
    model = toxicity.fit([])
    for text in ("you idiot", "you 1d10t", "you іdіоt", "ＩＤＩＯＴ!", "IDIOT"):
        assert model.score(text) > model.score("you there") + 0.2, text
    for text in ("the clown fish swims", "idiotic spelling of idiotype", "a moronic", "scumble", "price 1 000 $5", None, ""):
        assert model.hits(toxicity.fold(text or "")) == (0, 0), text


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>A &amp; B</h1><p>One  two<script>var x="</p>";</script> three.<p>Short.<p>The river and the stone are in the light of the day.<br>Next</article>
    <div id=comments><p>First! This is the best of all the comments on the page.</p></div><footer>&copy; us</footer></body></html>"""
    assert html_extract.extract(page) == "A & B\nOne two three.\nShort.\nThe river and the stone are in the light of the day. Next"
    assert html_extract.extract("") == "" and html_extract.extract("<nav>x</nav><!-- open") == "" and html_extract.extract("<p") == ""


BODY = "<h1>A title</h1><p>The river and the stone are in the light of the day.</p><p>Short.</p><p>And so it was for all of them, who had been there for a long time with no one to tell.</p>"
PLAIN = "A title\nThe river and the stone are in the light of the day.\nShort.\nAnd so it was for all of them, who had been there for a long time with no one to tell."
COMMENTS = '<div id="comments"><article class="comment"><p>First! This is the best of all that is on the page.</p></article></div>'


@pytest.mark.parametrize("before, after", [
    ("<article>", "</article>"), ('<div class="layout has-sidebar"><article>', "</article></div>"), ('<main class="content no-sidebar">', "</main>"), ('<article class="post share-enabled">', "</article>"),
    ('<div class="page with-nav"><article>', "</article></div>"), ('<form id="aspnetForm"><div>', "</div></form>"), ('<form id="f"><article>', "</article></form>"), ('<div class="sidebar-page"><main>', "</main></div>"), ("<div class=post>", "</div>"),
    ('<article><div class="social-share"><p>Share this with all of your friends.</p></div>', '<form><p>Write to us about it.</p></form></article><aside class="menu"><p>There is more of it.</p></aside>'),
])
def test_html_wrappers(before, after):
    for more in ("", COMMENTS):
        page = f'<html><body class="has-nav"><nav><a href="/">Home</a></nav><div class="cookieBanner"><p>We use cookies on this site.</p></div>{before}{BODY}{after}{more}<footer><p>All of the rights are ours.</p></footer></body></html>'
        assert html_extract.extract(page) == PLAIN


def plain_extract(page):
    """Well-formed pages whose text stands in article, by another parser."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.now, self.inside, self.off = [], "", 0, 0

        def cut(self):
            self.out += [" ".join(self.now.split())] if self.now.split() and self.inside and not self.off else []
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1", "h2", "article", "div", "li", "ul", "aside"):
                self.cut()
            self.inside += tag == "article"
            self.off += tag in ("aside", "script", "style")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "article", "div", "li", "ul", "aside"):
                self.cut()
            self.inside -= tag == "article"
            self.off -= tag in ("aside", "script", "style")

        def handle_data(self, data):
            self.now += data if not self.off else ""

    p = P()
    p.feed(page)
    return "\n".join(p.out)


def test_html_against_another_parser():
    r = random.Random(4)
    word = lambda: r.choice("the|and|river|of|stone|&amp;|in|<b>light</b>|day&nbsp;time|<i>x</i>|<script>var a='<p>';</script>|5 &lt; 6".split("|"))
    for _ in range(200):
        text = lambda: " ".join(word() for _ in range(r.randrange(1, 40)))
        body = "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<p class='x > y' title=\"it's\">{}</p>", "<ul><li>{}</li></ul>", "<aside>{}</aside>", "<!-- {} -->"]).format(text()) for _ in range(r.randrange(1, 9)))
        page = f"<html><body><nav><a href=x>{word()}</a></nav><article><p>the river is in the light of the day</p>{body}</article><footer>{word()}</footer></body></html>"
        assert html_extract.extract(page) == plain_extract(page), page


def test_html_broken_markup_in_linear_time():
    import time

    for bad in ("<a title=\"x>text</a> <b ' y=\"1\">" * 30_000, "<div>" * 10_000 + "</span>" * 130_000, "<object>x" * 110_000, "<a " + "x='" * 330_000, '<p "' * 250_000, "<!-- x " * 140_000, "<div class=a>" * 77_000):
        began = time.time()
        html_extract.extract(bad)
        assert time.time() - began < 4, bad[:40]


def test_html_table(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", BODY), (3, "u", f"<article>{BODY}"), (3, "u", f"<article>{BODY}"), (4, "u", "<p>" + "the river is long. " * 30_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()), key=repr)
    want = [(i, u, t, len(t)) for (i, u, _), t in zip(rows, ["", "", PLAIN, PLAIN, PLAIN, ("the river is long. " * 30_000).strip()], strict=True)]
    assert got == sorted(want, key=repr)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def brute_hits(text, items, size=13):
    w = [x.decode() for x in license_scan.ascii_words((text or "").encode())]
    hit, names = set(), set()
    for i, t in items:
        v = [x.decode() for x in license_scan.ascii_words((t or "").encode())]
        for k in range(max(1, len(v) - size + 1)) if v else ():
            g = v[k : k + size]
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    names.add(str(i))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_decontamination(spark, odd, none):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("the of And é3 x-y river Stone".split()) for _ in range(n))
    items = [(1, text(30)), (2, text(14)), (10, "Stone river"), (11, "the"), (12, None), (13, "..."), (14, text(13))]
    docs = [(k, f"{text(20)} {items[k % 2][1]} {text(9)}") for k in range(8)] + [(8, None), (9, "the"), (9, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in got) == sorted((d, *brute_hits(t, items)) for d, t in docs)
    assert decontaminate.contaminated(odd, bench).count() == len(ODD) and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = decontaminate.keep_clean(spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string"), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, t in docs if not brute_hits(t, items)[1]) and clean.columns == ["doc_id", "text", "key"]
    long = " ".join(f"w{k}" for k in range(30_000))
    got = decontaminate.contaminated(spark.createDataFrame([(1, f"{long} {items[2][1]} {long}")], "doc_id long, text string"), bench).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (60_002, 2, False)


def test_sharding(spark, odd, none):
    rows = [(i, f"t{i % 7 if i < 300 else i} " * (1 + i % 50)) for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == 900 and set(got.shard) == set(range(40)) and got["size"].sum() == sum(len(t) + 16 for _, t in rows)
    by = got.groupby("shard")["size"].sum()
    assert by.max() <= 1.05 * by.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(none).count() == 0


def test_sharding_of_repeated_rows(spark):
    # Most rows are equal, without ids: their group is split by row, and all three measures are balanced.
    rows = [(None, "the same text of a row " * 5)] * 3000 + [(k % 7, "w " * (k % 300 + 1)) for k in range(1000)] + [(1, None), (1, ""), (2, "\u00fc")]
    got = sharding.shard(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, unit int, shard int"), shards=12).toPandas()
    assert len(got) == len(rows) and sorted(got["size"]) == sorted(len((t or "").encode()) + 16 for _, t in rows)
    assert sorted(got.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    by = got.groupby("shard")
    for measure in (by["size"].sum(), by.size()):
        assert len(measure) == 12 and measure.max() <= 1.05 * measure.mean() and measure.min() >= 0.95 * measure.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in by)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1000), st.integers(1, 50), st.integers(1, 9)), min_size=1, max_size=60), st.integers(1, 6))
def test_placing(items, shards):
    sizes = np.array(items, float)
    to = sharding.place(sizes, shards, (1.0, 0.3, 0.3))
    assert len(to) == len(items) and set(to) <= set(range(shards))
    load = np.bincount(to, sizes[:, 0], shards)
    # No move or swap of two items between the extremes that keeps the other measures near would lower their difference further than one item.
    assert load.max() - load.min() <= max(sizes[:, 0].max(), 0.6 * sizes[:, 0].sum() / shards)


def brute_links(v, least=0.93):
    """(links by row, least id by row) of rows (id, vector, label); rows of one id share the component."""
    fine = [k for k, (i, e, y) in enumerate(v) if i is not None and y is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {k: np.array(v[k][1]) / max(map(abs, v[k][1])) for k in fine}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    links, root = [0] * len(v), list(range(len(v)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    groups = {}
    for k in fine:
        groups.setdefault((v[k][2], len(v[k][1])), []).append(k)
    for ks in groups.values():
        m = np.stack([unit[k] for k in ks])
        for at in range(0, len(ks), 1000):
            for x, y in zip(*np.nonzero(m[at : at + 1000] @ m.T >= least), strict=True):
                if ks[at + x] != ks[y]:
                    links[ks[at + x]] += 1
                    a, b = top(ks[at + x]), top(ks[y])
                    root[max(a, b)] = min(a, b)
    first = {}
    for k in fine:
        a, b = top(k), top(first.setdefault(v[k][0], k))
        root[max(a, b)] = min(a, b)
    low = {}
    for k in fine:
        low[top(k)] = min(v[k][0], low.get(top(k), v[k][0]))
    return links, [low[top(k)] if k in unit else v[k][0] for k in range(len(v))]


def check_vectors(spark, v, **options):
    schema = "vec_id long, embedding array<double>, label int, class string, n int, h string"
    got = embedding_dedup.linked(spark.createDataFrame([(*r, "x", 1, "y") for r in v], schema), **options).collect()
    links, low = brute_links(v)
    want = sorted(((i, n, c, i is None or i == c) for (i, _, _), n, c in zip(v, links, low, strict=True)), key=repr)
    assert sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in got), key=repr) == want


def test_embeddings(spark):
    r = np.random.default_rng(2)
    centers = r.standard_normal((40, 16))
    v = [(i, (centers[i % 40] + r.standard_normal(16) * 0.3).tolist(), i % 3) for i in range(900)]
    v += [(900, v[5][1], v[5][2]), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, v[6][1], None), (905, [], 1), (906, [x * 1e30 for x in v[7][1]], v[7][2])]
    v += [(None, v[8][1], v[8][2]), (907, [*v[9][1][:15], None], 0), (908, [1.0, 2.0], 0), (909, [2.0, 4.0], 0)]
    check_vectors(spark, v, shard_rows=150)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.linked(empty).count() == 0


def test_embeddings_of_repeated_ids(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    check_vectors(spark, [(7, x, 1), (3, x, 1), (7, y, 1), (9, y, 1), (9, z, 2), (11, z, 2), (11, z, 2), (12, z, 1), (7, x, 1), (13, None, 1), (13, y, 3)])


def test_embeddings_in_shards_of_thousands(spark):
    # Two shards of about 2,500 vectors: a third of all rows is one group of near copies, the others come in pairs.
    r = np.random.default_rng(6)
    n, d = 5000, 24
    v = r.standard_normal((n, d))
    v[: n // 3] = v[0] + 0.08 * r.standard_normal((n // 3, d))
    v[n // 3 + 1 : n : 2] = v[n // 3 : n - 1 : 2] + 0.1 * r.standard_normal((len(range(n // 3 + 1, n, 2)), d))
    check_vectors(spark, [(int(i), row.tolist(), 1) for i, row in zip(r.permutation(n), v, strict=True)], shard_rows=2500)


def test_forest_spans_what_links_join():
    r = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 20), (400, 300), (400, 5000)):
        forest, edges = embedding_dedup.Forest(n), r.integers(0, n, (m, 2))
        for at in range(0, m, 64):
            forest.link(edges[at : at + 64, 0], edges[at : at + 64, 1])
        kept, root = forest.links(), {}
        find = lambda k: k if root.get(k, k) == k else find(root[k])
        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        trees = len({find(k) for k in range(n)})
        assert len(kept) == n - trees and [find(k) for k in range(n)] == forest.root.tolist()


@pytest.mark.parametrize("same", [False, True])
def test_rare_links_at_full_shard_size(same):
    # 200 planted links among 12,000 vectors: a sample of 64 queries meets about one of them, or only itself.
    r = np.random.default_rng(1)
    n, d, planted = embedding_dedup.SHARD, 64, 200
    a, b = r.standard_normal((n, d)), r.standard_normal((n, d))
    at, to = r.permutation(n)[:planted], r.permutation(n)[:planted]
    b[to] = a[at] + 0.25 * r.standard_normal((planted, d))
    if same:
        a = b = np.concatenate([a[at], b[to], b[np.setdiff1d(np.arange(n), to)][: n - 2 * planted]])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    got = {(int(q), int(m)) for qs, ms in embedding_dedup.range_links(embedding_dedup.Graph(a), a, b, 0.93) for q, m in zip(qs, ms, strict=True)}
    want = {(int(q), int(m)) for at in range(0, n, 2000) for q, m in zip(*np.nonzero(b[at : at + 2000] @ a.T >= 0.93), strict=True) for q in [q + at]}
    assert len(want) >= planted and got == want


def test_proximity(spark):
    r = random.Random(8)
    docs = [(k, " ".join(r.choice("the the the of of and stone river light".split()) for _ in range(60))) for k in range(12)] + [(None, "stone of the river"), (20, None), (21, "the")]
    items = [(1, "stone the river of"), (2, "river"), (3, "light light"), (None, "light of and"), (4, "absent"), (5, None)]
    split = lambda t: (t or "").split()
    n, want = {}, {}
    for _, t in docs:
        for w in split(t):
            n[w] = n.get(w, 0) + 1
    for i, text in items:
        rare = [w for _, _, w in sorted((n[w], off, w) for off, w in enumerate(split(text)) if w in n)][:2]
        for d, t in docs:
            p1, p2 = ([p for p, w in enumerate(split(t)) if w == x] for x in (rare[:1] * 2 + rare[1:])[-2:]) if rare else ([], [])
            single = len(split(text)) == 1
            met = [(min(a, b), max(a, b)) for a in p1 for b in p2 if (a == b if single else a != b and abs(a - b) <= 4)]
            if met and (single or len(rare) == 2):
                want[d, i and str(i)] = (min(a for a, _ in met), max(b for _, b in met))
    got = decontaminate.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), within=4).collect()
    assert {(x.doc_id, x.item_id): (x.first, x.last) for x in got} == want and len(got) == len(want)
    assert {i for _, i in want} == {"1", "2", "3", None}
