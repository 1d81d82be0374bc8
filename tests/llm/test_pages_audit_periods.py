"""Pages, filter audit and periodic runs against brute force and hand-made cases."""

import hashlib
import html
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from namesieve.llm import audit, pages, periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
GOOD = "The quick brown fox and the lazy dog are in the garden of the house, and it was good for them to be there."
TABLES = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are absent")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def shipped(spark):
    from namesieve.llm.ship import ship

    return ship(spark)


# ---------------------------------------------------------------- pages

PAGES = {
    f"<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><article><header><h1>Title</h1></header><p>{GOOD}</p>"
    f'<div class="advert">{GOOD}</div><p>Short.</p><aside>{GOOD}</aside><ul><li><a href=/a>x</a><li><a href=/b>y</a>'
    f'</ul><footer>x</footer></article><section id="comments"><article>{GOOD}</article></section>': f"Title\n{GOOD}\nShort.",
    f"<div id=top><a href=/>Home</a> <a href=/b>Other</a></div><h1>Title</h1><p>{GOOD}<p>Short one.<p>{GOOD}</p>"
    "<div><a href=/>aa</a></div><div>far</div><div><a href=/>bb</a></div>": f"Title\n{GOOD}\nShort one.\n{GOOD}",
    f'<div class="sidebar">{GOOD}</div><div class="cookie-notice">{GOOD}</div><div id="content"><h2>T</h2>{GOOD}<br>more'
    f"<p>a &amp; &eacute;&nbsp;x &#65; &am</div><form>{GOOD}<p>{GOOD}</form>": f"T\n{GOOD} more\na & é x A &am",
    f"<nav><ul><li><a href=/>a</a><main><h1>T</h1><p>{GOOD}</main>": f"T\n{GOOD}",
    '<article><script>if(a<b){"</p>"}</script><p>a &lt;b&gt; is <!-- x --> ok</p><style>p{}</style><p>x': "a <b> is ok\nx",
    "<article><p title=\"a>b\">one<p it's>two</p><p>that's <b>three<i>x</b>y</i></article><p": "one\ntwo\nthat's threexy",
    "<article>a<!-- b": "a",
    f'<body class="with-sidebar"><main class="has-comments"><p>{GOOD}</p><div class="share">S</div></main>': GOOD,
    "<article><table><tr><td>a<td>b</table><p hidden>x</p><p>c<span class='ad'>no</span>d<button>B</button>": "a\nb\ncd",
    f"<article><h1>T</h1><p>{GOOD}</p><article>{GOOD}</article></article>": f"T\n{GOOD}",
    f"<main><h1>T</h1><p>{GOOD}</p><article>other</article></main>": f"T\n{GOOD}\nother",
    "<article>one</article><article>two</article>": "one\ntwo",
    "": "", " \n ": "", "just text": "just text", "<nav>menu</nav>": "",
}


def test_pages(shipped):
    rows = [(i, None, s, "x", 1) for i, s in enumerate(PAGES)] * 2
    rows += [(100, "u", None, "x", 1), (None, "u", "<article>n</article>", "x", 1), (101, "u", "<p>a " * 50000, "x", 1)]
    table = shipped.createDataFrame(rows, "page_id long, url string, html string, text string, blocks long")
    found = pages.main_text(table.repartition(4))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = Counter((r.page_id, r.text) for r in found.collect())
    want = Counter(dict.fromkeys(enumerate(PAGES.values()), 2))
    want.update([(100, ""), (None, "n"), (101, "\n".join(["a"] * 50000))])
    assert got == want
    assert all(r.n_chars == len(r.text) for r in found.collect())
    assert pages.main_text(table.where("false")).collect() == []
    other = table.select("html", "blocks").withColumnRenamed("html", "source")
    assert pages.main_text(other, ("blocks",), "source").columns == ["blocks", "text", "n_chars"]


def test_page_blocks(shipped):
    table = shipped.createDataFrame([(1, next(iter(PAGES)))], "page_id long, html string")
    blocks = pages.page_blocks(table, ("page_id",)).first().blocks
    places = [b.place for b in blocks]
    assert places.count("never") >= 5 and "article" in places
    links = [b for b in blocks if b.linked == 1.0 and b.place == "article"]
    assert [b.text for b in links] == ["x", "y"] and not any(b.content for b in links)
    good = next(b for b in blocks if b.text == GOOD and b.content)
    assert good.n_words == len(GOOD.split()) and 0.2 * good.n_words <= good.n_stop < good.n_words


def test_second_pass_takes_the_nearest_label():
    source = f"<p>{GOOD}</p><p>one</p><p>two</p><p>three</p><p>four</p><p><a href=x>link link link</a></p><p>five</p>"
    found = {b.text: b.label for b in pages.label_blocks(pages.Scan().page(source))}
    assert [found[t] for t in ("one", "two", "three", "four", "five")] == ["content"] * 2 + ["boilerplate"] * 3


def test_scan_is_linear():
    for source in ("<b>" * 30000 + "<p>x" * 30000, "<div>" * 30000, "<" * 90000, "<!--" * 30000, '<p x="' * 30000):
        pages.label_blocks(pages.Scan().page(source))


@TABLES
def test_pages_of_the_tables(shipped):
    from namesieve.llm.queries import op11_html_extraction

    got = {r.page_id: r.text for r in op11_html_extraction(shipped, SF).collect()}
    rows = shipped.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in p else "", p)).split()) for p in parts)
        assert got[r.page_id] == "\n".join(p for p in plain if p)


# ---------------------------------------------------------------- filter audit


def audit_rows():
    draw = random.Random(5)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [long, long + " #", "UP " * 130, "up " * 130, "a b", "", None, "A" * 9 + " $", long.upper(), "é " * 120]
    rows = [(i if draw.random() < 0.9 else None, draw.choice(texts), draw.choice(("en", "fr", None, ""))) for i in range(300)]
    return rows + [(7, long, "en")] * 5 + [(8, long, "fr")] * 3


def brute_audit(rows, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        failed = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        failed += "E" * (i is not None and i > least[text])
        docs[lang or ""].append((failed, i in good, i in toxic))
    cells = {}
    for part, each in docs.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = each
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                fails = sum(f in d[0] for d in each)
                only = sum(d[0] == f for d in each)
                lost = sum(d[1] for d in gone), sum(d[2] for d in gone)
                cells[part, order, step] = len(left), len(gone), fails - len(gone), only, *lost
        for (p, order, step), row in list(cells.items()):
            if p == part:
                cells[p, order, step] = *row[:6], shapley[order[step - 1]]
    return cells


def test_filter_audit(shipped):
    rows = audit_rows()
    labels = [(i, i % 3 == 0 and 1 or None, i % 5 == 0 and 1 or 0) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = shipped.createDataFrame([(*r, 1, "y") for r in rows], "doc_id int, text string, lang string, mask int, sha string")
    marks = shipped.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    found = audit.filter_audit(docs.repartition(5), marks)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert found.columns == ["part", "filter_order", "step", *names]
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in found.collect()}
    assert got == brute_audit(rows, labels) and len(got) == 3 * 600
    assert audit.filter_audit(docs.where("false"), marks).collect() == []
    alone = audit.filter_audit(docs, marks.where("false"))
    assert alone.agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0] == 0


@pytest.mark.parametrize("n", (1, 3, 5, 6))
def test_intervals_are_the_removing_orders(n):
    orders = list(permutations(range(n)))
    assert audit.order_names("ABCDEF"[:n]) == ["".join("ABCDEF"[i] for i in o) for o in orders]
    for mask in range(1 << n):
        want = {(r, next(s for s, f in enumerate(o, 1) if mask >> f & 1)) for r, o in enumerate(orders) if mask}
        spans = audit.removal_intervals(n, mask)
        got = [(r, step) for step, start, end in spans for r in range(start, end)]
        assert set(got) == want and len(got) == len(want)


def test_other_numbers_of_filters(shipped):
    masks = shipped.createDataFrame([("p", 3, True, False, 4), ("p", 0, False, False, 2)], "part string, mask int, good boolean, toxic boolean, n long")
    rows = {(r.filter_order, r.step): r for r in audit.step_totals(masks, "XY").collect()}
    assert rows["XY", 1].removed == 4 and rows["XY", 2].removed == 0 and rows["YX", 1].good_lost == 4
    assert rows["YX", 2].redundant == 4 and rows["YX", 2].kept == 2 and rows["XY", 2].shapley == 4
    with pytest.raises(ValueError):
        audit.step_totals(masks, "ABCDEFGHI")


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=12):
    codes = {w: i for i, w in enumerate(set(words))}
    w, found = np.array([codes[x] for x in words]), {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate(([0], (w[q:] == w[:-q]).astype(int), [0]))
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if b - a + q >= max(least, 2 * q):
                found.setdefault((int(a), int(b - a + q)), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, words):
    words, n, h = list(words), len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a + p, n):
            words[i] = words[i - p]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = best[1] * 1000 // best[2] if runs else None
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    return len(runs), *best, milli, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def check_runs(found, texts):
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in names) == brute_row(r.doc_id, WORD.findall(texts[r.doc_id] or ""))
    return rows


def periodic_texts():
    draw, texts = random.Random(6), [None, "", " \n", "a", "a " * 11, "a " * 12, "a b " * 5, "a b " * 6, "x " * 3000, "ab\xa0c " * 15]
    for i in range(400):
        n, k = draw.choice((5, 12, 30, 90, 300)), draw.choice((1, 2, 3, 8, 50))
        w = [draw.randrange(k) for _ in range(n)]
        for _ in range(draw.randrange(4)):
            a = draw.randrange(n)
            p, e = draw.randint(1, max(1, (n - a) // 2)), draw.randint(a, n)
            for j in range(a, e):
                w[j] = w[a + (j - a) % p]
        texts.append(draw.choice((" ", "\n", " \t\x0b")).join(map(str, w)))
    return texts + [texts[-1]] * 3


def test_periodic_runs(shipped):
    texts = periodic_texts()
    rows = [(i, t, 1, "r") for i, t in enumerate(texts)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, key int, runs string")
    found = periods.periodic_runs(docs.repartition(6), prepare=periods.plant)
    assert sum(r.n_runs for r in check_runs(periods.runs_digest(found), texts)) > 300
    assert periods.periodic_runs(docs.where("false")).collect() == []
    plain = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in plain[i].runs] == brute_runs(WORD.findall(t or ""))
    odd = shipped.createDataFrame([(None, "a b " * 9), ("k", "c " * 30), ("k", "c " * 30)], "doc_id string, text string")
    assert sorted(r.kept for r in periods.periodic_runs(odd).collect()) == ["a b", "c", "c"]


@pytest.mark.parametrize("rules", (periods.RunRules(2), periods.RunRules(6), periods.RunRules(30), periods.RunRules(12, 4)))
def test_other_lengths(rules):
    for text in periodic_texts()[5:150]:
        words = np.array([int(x) if x.isdigit() else ord(x[0]) + 1000 for x in WORD.findall(text)], np.int64)
        want = [r for r in brute_runs(words.tolist(), rules.min_length) if r[1] >= rules.min_repeats * r[2]]
        found = periods.find_runs(words, np.full(len(words), len(words)), rules)
        assert [tuple(r) for r in found.tolist()] == want


@TABLES
def test_periodic_runs_of_the_tables(shipped):
    from namesieve.llm.queries import op13_periodic_runs

    docs = shipped.read.parquet(f"{SF}/documents.parquet").collect()
    check_runs(op13_periodic_runs(shipped, SF), {r.doc_id: r.text for r in docs})
