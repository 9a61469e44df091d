from __future__ import annotations

import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sagebrook.llm import decontaminate, html_text, language, mixing, pii, quality, token_counts
from sagebrook.llm.common import Workspace

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 100_000


def held(i, n, r):
    return i is not None and zlib.crc32(str(i).encode()) % n == r


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    good = ["red", "green", "blue", "house", "tree", "river"]
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [rng.choice(good) + ("###" if bad else "") for _ in range(rng.choice([5, 20, 60]))]
        rows.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, int(not bad), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, LONG, "en", "s", 0), (None, "red tree", "en", "s", 0), (5, "red tree", "en", "s", 0)]
    marks += [(7, None, None), (None, 1, 0), (8, 1, 0)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality(spark, labelled):
    docs, labels = labelled
    rows = quality.score(spark, docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    right = [r.predicted == (r.doc_id % 3 != 0) for r in rows if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert sum(right) >= 0.95 * len(right)
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and 150 < kept.count() < docs.count()


def test_quality_without_labels(spark, labelled):
    docs, labels = labelled
    assert {r.score for r in quality.score(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score(spark, docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score(spark, docs.limit(0), labels).collect() == []


def test_quality_on_the_given_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.97


@pytest.mark.parametrize("held", [0, 1000])
def test_word_vectors_match_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(quality, "SUMMED", 40)
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["ab", "cd", "x", "77", "***", "é", "fgh,", "ij"], k=rng.randrange(12))) for _ in range(80)] + [None, "", "once", "twice twice", "never7seen"]

    def tokens(text):
        hashes, at, kinds = quality.token_hashes(pa.array([text], pa.string()))
        return [(int(h), int(k)) for h, k in zip(hashes.view(np.int64), kinds)]

    def index(h):
        return quality.index_vectors(np.array([h], np.int64).view(np.uint64))[0]

    sums, seen, kind_of = {}, Counter(), {}
    for text in texts:
        of = tokens(text)
        for i, (h, k) in enumerate(of):
            seen[h] += 1
            kind_of[h] = k
            near = [index(of[j][0]) for j in range(max(0, i - 2), min(len(of), i + 3)) if j != i]
            sums[h] = sums.get(h, 0) + (np.sum(near, axis=0) if near else np.zeros(quality.DIMENSIONS, int))
    kinds = {}
    for h, n in seen.items():
        if n < quality.RARE:
            kinds[kind_of[h]] = kinds.get(kind_of[h], 0) + sums[h]
    ws = Workspace(spark, "test")
    words, others = quality.word_vectors(ws, spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), held)
    axes = [f"v{i}" for i in range(quality.DIMENSIONS)]
    got = {r.token: (r.seen, [r[x] for x in axes]) for r in words.collect()}
    assert set(got) == {h for h, n in seen.items() if n >= quality.RARE} and len(got) >= 5 and kinds
    for h, (n, v) in got.items():
        assert n == seen[h] and v == pytest.approx((sums[h] / max(np.linalg.norm(sums[h]), 1)).tolist(), abs=1e-6)
    for r in others.collect():
        assert [r[x] for x in axes] == pytest.approx((kinds[r.kind] / max(np.linalg.norm(kinds[r.kind]), 1e-9)).tolist(), abs=1e-6)


def test_quality_whatever_workers_hold(spark, labelled):
    docs, labels = labelled
    docs = docs.withColumns({"row": F.lit("x"), "score": F.lit(1), "features": F.lit(None).cast("int")})
    want, got = ([(r.doc_id, r.predicted, round(r.score, 4)) for r in quality.score(spark, docs, labels, held=h).collect()] for h in (500_000, 3))
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == docs.count()
    kept = quality.keep_good(spark, docs, labels, held=3)
    assert kept.dtypes == docs.dtypes and sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(i) for i, p, _ in want if p)


def test_language(spark):
    rng = random.Random(2)
    kinds = {"aa": "kako lumi tarra", "bb": "schwitz quork brunft", "cc": "éàn ôrè cîel"}
    rows = [(i, " ".join(rng.choices(w.split(), k=12)) + f" {rng.randint(1, 99)}", k, "s", 0) for i, (k, w) in enumerate(random.Random(3).choices(list(kinds.items()), k=300))]
    rows += [(1000, None, "aa", "s", 0), (1001, "123 !!", "aa", "s", 0), (1002, "KAKOLUMI", None, "s", 0), (None, "quork", "bb", "s", 0), (1004, "kako " * 50_000, "aa", "s", 0)]
    found = {r.doc_id: r for r in language.identify(spark, spark.createDataFrame(rows, DOC)).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, _, _ in rows[:300]) and all(0 <= r.score <= 1 for r in found.values())
    assert found[1000].lang_pred == found[1001].lang_pred == "und" and found[1002].lang_pred == "aa" and found[1004].lang_pred == "aa"
    assert all(r.held_out == held(i, 3, 1) for i, r in found.items())
    assert language.identify(spark, spark.createDataFrame([], DOC)).collect() == []
    assert {r.lang_pred for r in language.identify(spark, spark.createDataFrame([(1, "abc", None, "s", 0)], DOC)).collect()} == {"und"}


def test_rare_language_is_learnt(spark):
    """A label at 0.01 % of the words."""
    rows = [(i, "kako lumi tarra " * 10_000, "aa", "s", 0) for i in range(20)] + [(100 + i, "schwitz quork brunft", "bb", "s", 0) for i in range(20)]
    found = language.identify(spark, spark.createDataFrame(rows, DOC)).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id < 100 else "bb") for r in found)
    assert 0 < sum(r.held_out for r in found if r.doc_id >= 100) < 20


def brute_languages(rows):
    """lang_pred and score of (doc_id, text, lang), one word after the other."""
    def letters(text):
        return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()

    counts = {}
    for i, text, lang in rows:
        if i is not None and not held(i, 3, 1) and lang is not None:
            for w in letters(text):
                for n, g in [(0, w)] + [(n, f"<{w}>"[k : k + n]) for n in (1, 2, 3, 4) for k in range(len(w) + 3 - n)]:
                    counts.setdefault(n, {}).setdefault(lang, Counter())[g] += 1
    langs = sorted(counts.get(0, {}))
    totals = {(n, x): c.total() for n, of in counts.items() for x, c in of.items()}

    def log(n, lang, g):
        return math.log(counts[n].get(lang, {}).get(g, 0) / totals.get((n, lang), 1) + 1e-9)

    def of_word(w):
        if any(w in counts[0][x] for x in langs):
            return [log(0, x, w) for x in langs]
        for n in (4, 3, 2, 1):
            known = [g for k in range(len(w) + 3 - n) if any((g := f"<{w}>"[k : k + n]) in counts[n].get(x, {}) for x in langs)]
            if known:
                return [sum(log(n, x, g) for g in known) / len(known) for x in langs]
        return [math.log(1e-9)] * len(langs)

    out = []
    for i, text, _ in rows:
        of = letters(text)
        if not of or not langs:
            out.append((i, "und", 0.0))
            continue
        totals_of = np.sum([of_word(w) for w in of], axis=0)
        odds = np.exp((totals_of - totals_of.max()) / np.sqrt(len(of)))
        out.append((i, langs[int(np.argmax(np.round(totals_of, 7)))], 1 / odds.sum()))
    return out


@pytest.mark.parametrize("entries", [0, 60, 400_000])
def test_languages_match_brute_force(spark, entries):
    """Whatever part of the words the workers hold."""
    rng = random.Random(5)
    letters = {k: rng.sample("abcdefghijklmnopqrst", 8) for k in ("aa", "bb", "cc", "dd", "ee")}
    texts = [(k, " ".join("".join(rng.choices(of, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 25)))) for k, of in letters.items() for _ in range(40)]
    rows = [(i, t, k) for i, (k, t) in enumerate(texts)] + [(300, None, "aa"), (301, "12 !", "bb"), (302, "ß øøø", None), (3, texts[3][1], "aa"), (None, "abc", "bb"), (303, "", None), (304, "½ ² Ⅷ ١٢", "cc"), (305, "x½y z²", "dd"), (306, "q" * 50_000, "ee")]
    docs = spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in rows], DOC).withColumns({"word": F.lit(1), "row": F.lit("x"), "place": F.lit(2)})
    found = language.identify(spark, docs, entries).collect()
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in found)
    by = sorted(((r.doc_id or -1, r.lang_pred, round(r.score, 6)) for r in found))
    assert by == sorted((i or -1, x, round(s, 6)) for i, x, s in brute_languages(rows))
    assert language.identify(spark, docs.limit(0), entries).collect() == []


def test_language_on_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = language.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_base_spans():
    text = "a.b@c.d.e, 1.2.3.4, 999.1.1.1, 4111 1111-1111 1111, 4111111111111112, +1 (234) 567-8901, +12 3"
    found = [(text[a:b], pii.BASE[k]) for a, b, k in pii.base_spans(text)]
    assert found == [("a.b@c.d.e", "email"), ("1.2.3.4", "ip"), ("4111 1111-1111 1111", "card"), ("+1 (234) 567-8901", "phone")]
    assert pii.base_spans("1" * 5000) == [] and pii.base_spans("") == [] and pii.base_spans("é 1.2.3.4")[0][:2] == (2, 9)


def plain_base_spans(text):
    patterns = zip(pii.BASE, (pii._EMAIL, pii._IP, pii._CARD, pii._PHONE), strict=True)
    return sorted(((m.start(), m.end(), k) for k, (kind, p) in enumerate(patterns) for m in p.finditer(text) if pii._passes(kind, m[0])), key=lambda s: (s[0], s[2]))


def test_base_spans_are_the_plain_patterns(sf_dir):
    rng = random.Random(1)
    for letters in ("ab@.1-_ ", "1.2 ", "0123456789 -+().", "a1@.é "):
        for _ in range(5000):
            text = "".join(rng.choices(letters, k=rng.randrange(40)))
            assert pii.base_spans(text) == plain_base_spans(text)
    texts = [t or "" for t in pq.read_table(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")["text"].to_pylist()]
    assert [pii.base_spans(t) for t in texts] == [plain_base_spans(t) for t in texts]


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for text in ("1" * 1_000_000, "1" * 500_000 + "." + "2" * 500_000, "a" * 1_000_000 + "@", "x1" * 500_000, "+1" + " " * 1_000_000):
        assert pii.base_spans(text) == [] and pii.train().added(text, []) == []
    assert time.perf_counter() - began < 10
    assert len(pii.base_spans("1." * 40_000)) == 10_000


def test_memory_is_bounded():
    field = pii.Field(pii.train().weights)
    for i in range(3000):
        field.added(f"call {i:03d}-{i * 7 % 1000:03d}-{i * 37 % 10000:04d} or x{i}@y{i}.zz about {i}.{i}", [])
    assert len(field.kept) <= pii.Field.KEPT and pii._shape.cache_info().currsize <= 20_000


def test_field_on_the_given_documents(sf_dir):
    """The field by itself finds the base spans of documents that no rule of its training wrote, and
    all that stands in quotes after a token's name."""
    field, base, found, secrets, seen = pii.train(), 0, 0, 0, 0
    for text in pq.read_table(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")["text"].to_pylist():
        own = set(pii.base_spans(text or ""))
        got = {s for a, b in pii.regions(text or "") for s in field.decode(text, a, b)}
        base, found = base + len(own), found + len(own & got)
        for m in re.finditer(r'token = "([0-9a-f]{32,64})"', text or ""):
            secrets, seen = secrets + 1, seen + ((*m.span(1), 4) in got)
    assert base > 40 and found >= 0.98 * base and secrets > 5 and seen >= 0.95 * secrets


#: Written by hand: a text, and what of it is personal data.
BY_HAND = [
    ("Write to anna.maria+news@post.example.org before May.", ["anna.maria+news@post.example.org"]),
    ("The server at 10.0.12.7 answers, 10.0.12.700 does not.", ["10.0.12.7"]),
    ("Paid with 4111 1111 1111 1111 on 2024-03-05.", ["4111 1111 1111 1111"]),
    ("Our phone 555-201-3344 is busy, tel (555) 201-3345 is free.", ["555-201-3344", "(555) 201-3345"]),
    ("From abroad: +44 20 7946 0958.", ["+44 20 7946 0958"]),
    ("password: 5f4dcc3b5aa765d61d8327deb882cf99", ["5f4dcc3b5aa765d61d8327deb882cf99"]),
    ('API_KEY="9a0364b9e99bb480dd25e1f0284c8555d9c8e1aa"', ["9a0364b9e99bb480dd25e1f0284c8555d9c8e1aa"]),
    ("See commit 9a0364b9e99bb480dd25e1f0284c8555d9c8e1aa for more.", []),
    ("Version 3.11.4 of 2023, pages 12-15, 40% off, room 4-201.", []),
    ("Order 1234567890123 came on 12/11/2020 at 10:45.", []),
    ("He scored 301-221-1045 points over three years.", []),
]


def test_field_on_sentences_written_by_hand():
    right = wrong = missed = 0
    for text, want in BY_HAND:
        base = pii.base_spans(text)
        got = {text[a:b] for a, b, _ in base + pii.train().added(text, base)}
        right, wrong, missed = right + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    assert 2 * right / (2 * right + wrong + missed) >= 0.85, (right, wrong, missed)


def test_field_finds_what_it_is_trained_for():
    field = pii.train()
    wrong = 0
    for text, spans in pii.sentences(7, 200):
        wrong += sorted(s for a, b in pii.regions(text) for s in field.decode(text, a, b)) != sorted(spans)
    assert wrong <= 4


def test_decoding_is_the_best_segmentation():
    """Against all segmentations of short regions."""
    field = pii.train()
    for text, _ in pii.sentences(11, 25):
        for start, end in pii.regions(text):
            pieces, found = pii.segments(text, start, end)
            if len(pieces) > 11 or not found:
                continue
            scores = field.scores(text, found).max(axis=1)

            def best(i, pieces=pieces, found=found, scores=scores):
                if i >= len(pieces):
                    return 0.0
                return max([best(i + 1), *(scores[s] + best(j) for s, (a, j, _, _) in enumerate(found) if a == i)])

            got = sum(field.scores(text, [x for x in found if x[2:] == (a, b)])[0, k] for a, b, k in field.decode(text, start, end))
            assert got == pytest.approx(best(0))


def test_pii_rows(spark):
    secret = "0123456789abcdef0123456789abcdef01234567"
    texts = ["mail x@y.zz now", f'token = "{secret}"', None, "", LONG + "1.2.3.4", "plain words, 2024 and 3.5"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    clashing = df.union(df.where("doc_id = 0")).withColumns({"spans": F.lit(1), "n_ip": F.lit("x")})
    assert sorted((r.doc_id, r.spans) for r in pii.find(spark, clashing).collect())[:2] == [(0, "email:5:11")] * 2
    assert pii.masked(spark, clashing.withColumn("doc_id", F.lit(None).cast("long"))).where("text = 'mail [EMAIL] now' and spans = 1").count() == 2
    rows = {r.doc_id: r for r in pii.find(spark, df).collect()}
    assert rows[0].spans == "email:5:11" and rows[0].n_email == 1 and rows[1].spans == "secret:9:49" and rows[1].n_card == 0
    assert rows[4].spans == "ip:500000:500007" and rows[2].spans == rows[3].spans == rows[5].spans == ""
    out = {r.doc_id: r for r in pii.masked(spark, df).collect()}
    assert out[0].text == "mail [EMAIL] now" and out[0].n_chars == 16 and out[1].text == 'token = "[SECRET]"' and out[2].text is None and out[5].text == texts[5]
    assert pii.find(spark, df.limit(0)).collect() == []


def test_mask_overlapping():
    assert pii.mask("abcdefgh", [(1, 4, 0), (2, 6, 1), (7, 8, 2)]) == "a[EMAIL]g[CARD]"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy now</div><div id="cookie-notice">We use cookies to serve you better.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>
 paragraph.<p>Second<br>one &lt;here&gt;.</p><aside>See also</aside><form><p>Sign up</p></form><section class="comments"><p>Nice!</p></section></article>
<div class="sidebar">Latest</div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst bold paragraph.\n\nSecond one <here>."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p> </p>") == ""
    assert html_text.main_text("<article>cut <b>off") == "cut off" and html_text.main_text("</p></div><article>x</article>") == "x"
    assert html_text.main_text("<article><p>a < b and c > d</p><!-- no <p> --></article>") == "a < b and c > d"
    long = " ".join(f"w{i}" for i in range(30_000))
    assert html_text.main_text(f"<article><p>{long}</p></article>") == long


def test_main_text_without_an_article():
    text = "A sentence that is long enough to be text. " * 5
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><div><h2>A title here</h2><p>{text}</p><p>{text}</p></div><div><a href=q>More of this</a></div>"
    assert html_text.main_text(page) == f"A title here\n\n{text.strip()}\n\n{text.strip()}"


TEXT = "A sentence that is long enough to be text. " * 5
BODY = f"<h1>A title here</h1><p>{TEXT}</p><p>{TEXT}</p>"
MAIN = f"A title here\n\n{TEXT.strip()}\n\n{TEXT.strip()}"


@pytest.mark.parametrize(
    "page",
    [
        *(f"<body class='{x}'><nav><a href=/>Home</a></nav><article>{BODY}</article><footer>me</footer>" for x in ("no-sidebar", "has-sidebar", "comments-open post", "sidebar", "search-results")),
        *(f"<body><nav><a href=/>Home</a></nav><div {x}><article>{BODY}</article></div>" for x in ("style='overflow:hidden'", "data-id='search'", "title='no id=menu here'", "class='has-sidebar'", "class='long-form'", "class='entry-header'", "class='sidebar-right'", "data-hidden=1")),
        *(f"<body><article {x}>{BODY}</article>" for x in ("title='The hidden valley'", "class='post comments-open'", "id='search'", 'title=\'say "hidden\'')),
        f"<body><form id=aspnetForm action=x><nav><a href=/>Home</a></nav><article>{BODY}</article><div class=search>Find it</div></form>",
        f"<body><form><nav><a href=/>Home</a></nav><div>{BODY}</div><footer>me</footer></form>",
        f"<article><header class='entry-header'><h1>A title here</h1></header><p>{TEXT}</p><p>{TEXT}</p></article>",
    ],
)
def test_main_text_within_loose_names(page):
    assert html_text.main_text(page) == MAIN


@pytest.mark.parametrize("part", ["<div hidden>", "<div class=x HIDDEN=''>", "<div class='a sidebar'>", "<div id=cookie-notice>", "<div class=site-header>", "<div role=banner>", "<div aria-hidden=true>", "<form>", "<div class='no-js menu'>", "<div class=contact-form>"])
def test_other_parts_stay_out(part):
    assert html_text.main_text("<div class=menu>" * 5_000 + "x") == ""
    tag = part[1:].split()[0].rstrip(">")
    assert html_text.main_text(f"<body>{part}Buy or read some other thing</{tag}><article>{BODY}</article><div id=comments><article class=comment><p>Nice one!</p></article></div>") == MAIN


def test_tree_knows_its_table():
    right = [bool(g) == bool(b[4]) for page in html_text.TABLE for g, b in zip(html_text.classify(html_text.table_features([b[:4] for b in page])), page, strict=True)]
    assert np.mean(right) >= 0.95


def test_broken_pages_take_linear_time():
    n = 60_000
    pages = ["<a " * n, "<a " * n + ">", "<a \"'" * n, "<div>" * n + "x" + "</div>" * n, "<script>" + "</script " * n, "<! " * n, "<a '> <b \"> " * n, "<head>" * n + "<article>" * n, "<nav>" * n + "x", "</p>" * n]
    began = time.perf_counter()
    assert [html_text.main_text(x) for x in pages][0] == ("<a " * n).strip()
    assert time.perf_counter() - began < 20


def test_what_stands_within_a_line_does_not_cut_it():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <svg><text>drawn</text></svg>, <object>kept</object><script>no()</script> <my-word>here</my-word>.</p><noscript>And shown</noscript><p>a <b title='x > y'>b</b> c</p></article>"
    assert html_text.main_text(page) == "Let x=2 be drawn, kept here.\n\nAnd shown\n\na b c"


def lists(n, word="Some page"):
    return "".join(f"<li><a href=/{i}>{word} {i}</a></li>" for i in range(n))


#: Pages that carry no mark, written by hand, with their main text: what decides is words and links.
UNMARKED = [
    (f"<ul>{lists(6)}</ul><h2>On rivers</h2><p>{TEXT}</p><p>It was <a href=x>so</a>. {TEXT}</p><ul>{lists(5)}</ul>", f"On rivers\n\n{TEXT.strip()}\n\nIt was so. {TEXT.strip()}"),
    (f"<table><tr><td><a href=/>Home</a><td><a href=/a>All news</a><td><a href=/b>Our shop</a></table><p>{TEXT * 3}</p><div><a href=1>Next one</a></div><div><a href=2>The one before</a></div><div><a href=3>Top</a></div>", (TEXT * 3).strip()),
    (f"<div><a href=1>One link of some words here</a></div><div><a href=2>Another link of some words</a></div><div>{TEXT}</div><div>{TEXT}</div><div>{TEXT}</div>", "\n\n".join([TEXT.strip()] * 3)),
    (f"<article><h1>Long lists</h1><ul>{lists(7, 'Part')}</ul><p>{TEXT * 2}</p><p>{TEXT} <a href=x>{TEXT}</a></p></article>", f"Long lists\n\n{(TEXT * 2).strip()}\n\n{TEXT}{TEXT.strip()}"),
    (f"<article><p>{TEXT}</p><p>{TEXT}</p><ul>{lists(5, 'Tag')}</ul></article><p>Yours.</p>", f"{TEXT.strip()}\n\n{TEXT.strip()}"),
    (f"<main><ul>{lists(9, 'Go')}</ul><h1>A head</h1><p>{TEXT}</p><p>Short.</p><p>{TEXT * 4}</p></main>", f"A head\n\n{TEXT.strip()}\n\nShort.\n\n{(TEXT * 4).strip()}"),
]


def test_words_and_links_decide_where_no_mark_does():
    right = wrong = missed = 0
    for page, want in UNMARKED:
        got, want = html_text.main_text(page).split("\n\n"), want.split("\n\n")
        right += len([b for b in got if b in want])
        wrong += len([b for b in got if b not in want])
        missed += len([b for b in want if b not in got])
    assert 2 * right / (2 * right + wrong + missed) >= 0.9
    rng, changed, n = np.random.default_rng(1), 0, 0
    for page, _ in UNMARKED:
        x = html_text.table_features([(b.words, b.linked, b.other, b.inside) for b in html_text.blocks_of(page)])
        for _ in range(20):
            mixed = x.copy()
            mixed[:, :6] = x[rng.permutation(len(x)), :6]
            changed += (html_text.classify(mixed) != html_text.classify(x)).sum()
            n += len(x)
    assert changed >= n / 3


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x", 5), (1, "u", PAGE, "x", 5), (2, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    rows = html_text.extract(spark, df).collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, len(html_text.main_text(PAGE)))] * 2 + [(2, 0)] and html_text.extract(spark, df.limit(0)).collect() == []


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_counter_is_the_library():
    from tokenizers import Tokenizer

    path = tokenizer()
    count, library, rng = token_counts.Counter(path), Tokenizer.from_file(path), random.Random(4)
    pieces = ["a", "Wörter", " ", "  ", "\n", "\t", "1", "'s", "!!", "<|endoftext|>", " ", "　", "x y", "\x1c", "​", "\U0001f600"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(3000)] + ["", LONG]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_tokens_and_cache(spark, tmp_path):
    path, cache = tokenizer(), f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "a b c", "", "", 0), (2, "a b c", "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0), (None, "é" * 600, "", "", 0), (6, "new one", "", "", 0)], DOC)
    first = token_counts.count_tokens(spark, df.where("doc_id is null or doc_id < 6"), path, cache).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in first} == {(1, 5, 3, False), (2, 5, 3, False), (3, 0, 0, False), (4, 0, 0, False), (None, 1200, 600, True)}
    assert spark.read.parquet(cache).count() == 3
    clashing = df.union(spark.createDataFrame([(7, LONG, "", "", 0)], DOC)).withColumns({"content": F.lit(1), "n_tokens": F.lit("x"), "counted": F.lit(True)})
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, clashing, path).collect()}
    assert counts[7] == token_counts.Counter(path)([LONG])[0] and counts[1] == 3 and len(counts) == 7
    assert len(token_counts.count_tokens(spark, df, path, cache).collect()) == 6
    stored = spark.read.parquet(cache)
    assert stored.count() == 4 and stored.select("content").distinct().count() == 4
    assert token_counts.count_tokens(spark, df.limit(0), path).collect() == []


def test_other_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    assert token_counts.Counter(public.path("piece_bpe_32k.model"))(["a b", ""]) == [len(piece.encode("a b")), 0]
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    assert token_counts.Counter(public.path("word_bpe_49k.json"))(["A  big Word", ""]) == [len(word.encode("A  big Word", add_special_tokens=False).ids), 0]


def mixed(spark, rows):
    return mixing.mix(spark, spark.createDataFrame(rows, DOC)).collect()


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 3, 10, 40]), None, rng.choice(["a", "b", "c", "d", None]), 0) for i in range(2000)]
    rows += [(5000 + i, "x y z", None, "tiny", 0) for i in range(5)] + [(6000, None, None, "a", 0), (6001, "", None, "a", 0)]
    out = mixed(spark, rows)
    assert len(out) == len(rows) and out and all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in out)
    by = {i: s for i, _, _, s, _ in rows}
    total, goal = {}, {}
    for r in out:
        total[by[r.doc_id]] = total.get(by[r.doc_id], 0) + r.taken
        goal[by[r.doc_id]] = (r.target, r.source_size)
    size = sum(r.size for r in out)
    assert sum(t for t, _ in goal.values()) == pytest.approx(size) and goal["tiny"] == (45, 15)
    assert all(abs(total[s] - t) <= 10 and t <= 3 * n for s, (t, n) in goal.items())
    level = goal["a"][0]
    assert [round(goal[s][0] / level, 6) for s in ("b", "c", "d")] == [2, 3, 1]
    again = mixing.mix(spark, spark.createDataFrame(rows[::-1], DOC).repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


@pytest.mark.parametrize("rows, most", [(50, 0.01), (400, 0.002)])
def test_mixing_where_all_are_wanted_alike(spark, rows, most):
    """Sources whose documents are all wanted nearly never, nearly once, or nearly three times."""
    rng = random.Random(rows)
    of = {"a": 1, "b": 40, "c": 1, "d": 1.01, "e": 0.36, "f": 3}
    docs = [(10_000 * k + i, "w " * round(f * rng.choice([5, 20, 60, 100, 300, 1500])), None, s, 0) for k, (s, f) in enumerate(of.items()) for i in range(rows)]
    out = mixed(spark, docs)
    total, goal = Counter(), {}
    for r in out:
        s = "abcdef"[r.doc_id // 10_000]
        total[s] += r.taken
        goal[s] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(total[s] - t) <= max(most * t, 40) for s, t in goal.items()), (total, goal)


def test_mixing_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    total, goal = Counter(), {}
    for r in mixing.mix(spark, docs).collect():
        total[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert all(abs(total[s] - t) <= 0.005 * t for s, t in goal.items())


def brute_targets(sizes):
    """Targets by raising a common level in small steps: weights 1, 2, 3 in order, null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, low, high = sum(sizes.values()), 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weight[s] * level, 3 * n) for s, n in sizes.items()) < total else (low, level)
    return {s: min(weight[s] * high, 3 * n) for s, n in sizes.items()}


def test_targets_match_brute_force(spark):
    rng = random.Random(11)
    for n in (1, 2, 7, 40):
        rows = [(i, "w " * rng.choice([1, 5, 30]), None, rng.choice([None, *(f"s{k}" for k in range(n))]), 0) for i in range(6 * n)]
        rows += [(1000 + i, LONG, None, "s0", 0) for i in range(2)] + [(2000, "q " * 900, None, "z", 0)]
        by, sizes = {i: s for i, _, _, s, _ in rows}, Counter()
        for _, t, _, s, _ in rows:
            sizes[s] += len(t.split())
        docs = spark.createDataFrame(rows, DOC).withColumns({"size": F.lit("x"), "target": F.lit(1), "p": F.lit(2)})
        out, want = mixing.mix(spark, docs).collect(), brute_targets(sizes)
        assert len(out) == len(rows) and all(r.target == pytest.approx(want[by[r.doc_id]], rel=1e-6) and r.source_size == sizes[by[r.doc_id]] for r in out)
        assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in out)


def test_shifts_are_handed_on(spark):
    """What documents near 0 or 1 can't take, others do."""
    ws = Workspace(spark, "test")
    units = spark.createDataFrame([("a", i, 10, 1, 0, p) for i, p in enumerate([0.99, 0.98, 0.5, 0.4])] + [(None, 9, 5, 1, 0, 0.5)], "source string, doc_id long, size long, rows long, whole long, p double")
    out = mixing._shifted(ws, units, spark.createDataFrame([("a", 8.0), (None, -100.0)], "of string, owed double")).collect()
    assert sum(r.p * r.size for r in out if r.source) == pytest.approx(28.7 + 8, abs=0.5) and all(0 <= r.p <= 1 for r in out) and [r.p for r in out if r.source is None] == [0.0]


def test_mixing_edges(spark):
    assert mixed(spark, []) == []
    assert [tuple(r) for r in sorted(mixed(spark, [(1, None, None, "a", 0), (2, " ", None, None, 0)]))] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    same = mixed(spark, [(1, "a b c", None, "s", 0)] * 10 + [(2, "q " * 60, None, "t", 0)])
    assert len(same) == 11 and sum(r.taken for r in same if r.doc_id == 1) == pytest.approx(same[0].target, abs=3) and max(r.taken for r in same if r.doc_id == 1) - min(r.taken for r in same if r.doc_id == 1) <= 3


def test_expectation_is_kept(spark):
    """Over many sources of the same documents each is taken as often as its probability says."""
    rows = [(k * 10 + i, "w " * s, None, f"s{k:04d}", 0) for k in range(600) for i, s in enumerate([1, 2, 3, 4, 5])]
    out = [r for r in mixed(spark, rows) if r.target < r.source_size]
    share = out[0].target / out[0].source_size
    for size in (1, 2, 3, 4, 5):
        of = [r.taken / r.size for r in out if r.size == size]
        assert np.mean(of) == pytest.approx(share, abs=0.15)


def contained(texts, items):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {j: grams(t) for j, t in items}
    return sorted((i, j, len(s), len(grams(t) & s)) for i, t in texts for j, s in sets.items() if s and 100 * len(grams(t) & s) >= 75 * len(s))


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    words = ["v%d" % i for i in range(400)]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([2, 5, 9, 30, 120])))) for j in range(40)] + [(100, None), (101, "")]
    texts = [(1, None), (2, ""), (3, items[0][1].upper())]
    for i in range(10, 90):
        own = rng.choices(words, k=rng.choice([3, 50, 400]))
        for _ in range(rng.choice([0, 1, 2])):
            piece = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                piece[rng.randrange(len(piece))] = "zz"
            at = rng.randrange(len(own))
            own[at:at] = piece
        texts.append((i, " ".join(own)))
    # Rows of one doc_id are one document, wherever an item is cut.
    long = next(t for _, t in items[:40] if len(t.split()) == 120).split()
    cut = [(500, " ".join(long[:64])), (500, " ".join(long[60:])), (500, None), (501, " ".join(long[:64])), (502, "q " * 200_000 + " ".join(long) + " q" * 100_000)]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in texts + cut] + [(None, items[5][1], "", "", 0)], DOC).withColumns({"item_id": F.lit("x"), "shingle": F.lit(1), "n_item": F.lit(2)})
    texts += [(500, " ".join(long)), *cut[-1:]]
    bench = spark.createDataFrame([(j, t, 1) for j, t in items] + [(None, "a b c d e", 1)], "item_id long, text string, n_doc int")
    want = contained(texts, items)
    rows = decontaminate.contained_items(spark, docs, bench).collect()
    assert len(want) > 20 and sorted((r.doc_id, r.item_id, r.n_item, r.n_common) for r in rows) == want
    assert decontaminate.contained_items(spark, docs.limit(0), bench).collect() == decontaminate.contained_items(spark, docs, bench.limit(0)).collect() == []


SLUGS = "search-algorithms comments-on-the-method social-history legal-basis menu-items related-work alert-levels footer share login banner notice promotion sidebar header ads nav newsletter".split()


@pytest.mark.parametrize("slug", SLUGS)
def test_main_text_whatever_its_parts_are_called(slug):
    """Ids made from headings drop nothing of an article; off it they do if they say nothing else."""
    words = " ".join(["word"] * 30)
    for page, want in (
        (f"<article><h1>Title</h1><h2 id='{slug}'>Heading</h2><p>{words}</p></article>", f"Title\n\nHeading\n\n{words}"),
        (f"<article><h1>Title</h1><section id='{slug}'><h2>Heading</h2><p>{words}</p><p>{words}</p></section></article>", f"Title\n\nHeading\n\n{words}\n\n{words}"),
        (f"<main><article><div id={slug}><p>{words}</p></div></article></main>", words),
        (f"<article><h2 class='{slug}'>Heading</h2><p>{words}</p></article>", f"Heading\n\n{words}"),
    ):
        assert html_text.main_text(page) == want
    if "-" in slug:
        loose = f"<nav><a href=x>Home</a></nav><div><h1>Some title of it</h1><section id='{slug}'><h2 id='{slug}'>Heading of it</h2><p>{words}</p><p>{words}</p></section></div>"
        assert html_text.main_text(loose).endswith(f"{words}\n\n{words}")


@pytest.mark.parametrize("part", ["<div id=comments><p>{}</p></div>", "<section id='comment-list'><ol><li>{}</li></ol></section>", "<div class='ad'>{}</div>", "<div class=share-bar>{}</div>", "<form id=any><p>{}</p></form>", "<aside><p>{}</p></aside>", "<div class='cookie-notice'><p>{}</p></div>", "<div id=disqus_thread>{}</div>"])
def test_other_parts_of_an_article_still_go(part):
    words = " ".join(["word"] * 30)
    page = f"<article><h1>Title</h1><p>{words}</p>{part.format('Something else entirely')}<p>{words}</p></article>"
    assert html_text.main_text(page) == f"Title\n\n{words}\n\n{words}"
