"""Operators 11, 12 and 13: edge cases, and brute force."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("cartoweave.llm")
from cartoweave.llm import html_text, language_id, quality_rules, resampling, simhash, vector_codes  # noqa: E402
from cartoweave.llm.common import table  # noqa: E402

PAGES = "page_id long, url string, html string, element long, text string, row int"


def pages(spark, rows):
    """Rows of (page_id, url, html) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], PAGES)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


# Operator 11


@pytest.mark.parametrize(
    "given, want",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more&nbsp;\n here", "just text & more here"),
        ("<title>T</title><p>a<p>b<script>'</p>'</script>c", "a\nbc"),
        ("<p>one <b>two<br>three</p><div>four</div>", "one two three\nfour"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table>", "a\nb\nc\nd\ne"),
        ("<!-- <p>no</p> --><p>yes<!-- no --></p><p>5 < 6 <3</p>", "yes\n5 < 6 <3"),
        ("<!-- never closed <p>no", ""),
        ("<nav>n</nav><header>h</header><p>x</p><aside>a</aside><footer>f</footer><form>q<input></form>", "x"),
        ("<p>out<article><header><h1>T</h1></header><p>x<footer>f</footer><div class='social-share'>s</div></article><p>out", "T\nx"),
        ("<form><main><p>x</main></form>", "x"),
        ("<main></main><p>x", "x"),
        ("<div class='no-sidebar has-ads'><p>x</p></div><div id=sidebar><p>y</div><div class=adBox>z</div>", "x"),
        ("<article><p>x</p><section class='comments'><article>c</article></section></article>", "x"),
        ("<p>a <span class='ad'>b</span> c</p><p hidden>d</p><p style='display: none'>e</p><p aria-hidden=true>f", "a c"),
        ("<p title='a > b'>x</p><p title=\"open>y</p>", "x\ny"),
        ("<p>&copy; &#233; &#x263A; &lt;b&gt;</p>", "© é ☺ <b>"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "deep\nafter"),
        ("<" * 5000, "<" * 5000),
        ('<a "' * 5000 + ">x", "x"),
    ],
)
def test_blocks(given, want):
    assert html_text.main_text("http://h/", given, frozenset()) == want


def test_articles_of_the_given_pages(spark, sf):
    """The given pages have one article each, of headings and paragraphs."""

    def plain(page):
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        return "\n".join(b for b in blocks if b)

    given = table(spark, sf, "pages")
    want = {r.page_id: (r.url, plain(r.html)) for r in given.collect()}
    got = html_text.op11_html_text(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: (r.url, r.text) for r in got.collect()} == want and got.where("n_chars <> length(text)").count() == 0


def site(n, rng, host="s.example"):
    """Pages of one host: menus and notices without telling names, articles of their own, some in `article`."""
    words = [f"w{i}" for i in range(4000)]
    out = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(rng.choices(words, k=30))}</p>" for _ in range(rng.randint(1, 4)))
        top = "<div><div>Home</div><div>About us</div></div>"
        end = f"<div><p>All rights reserved by the makers of this site, page {i % 3}</p></div>"
        inner = f"{body}<p>Subscribe to our letter now</p>" if i % 2 else body
        out.append((i, f"https://{host.upper() if i % 5 == 0 else host}:8080/{i}", f"<body>{top}<{'article' if i % 2 else 'div'}>{inner}</{'article' if i % 2 else 'div'}>{end}</body>"))
    return out


def brute_low(rows):
    """The style trees of all hosts, built in memory from nested sequences; the paths of low branches by host and zone."""
    seen = defaultdict(list)
    for _, url, page in rows:
        if html_text.host_of(url):
            inside, kids = html_text.read_page(page)
            seen[html_text.host_of(url), inside].append(kids)
    low = set()
    for (host, zone), all_pages in seen.items():
        m_all = len(all_pages)
        if m_all < html_text.LEAST_PAGES:
            continue

        def visit(path, found, inside, m_all=m_all, host=host):
            """found: (page, kids) of one element; returns (importance, most) and notes low branches."""
            by_page = defaultdict(list)
            for page, kids in found:
                by_page[page].append(kids)
            if len(by_page) == 1 and len(found) == len(by_page):
                return 1.0, 1.0
            styles, kids_of, leaf = defaultdict(set), defaultdict(list), defaultdict(Counter)
            for page, kids in found:
                if all(isinstance(k, str) for k in kids):
                    styles[None].add(page)
                    for r in html_text.runs_of(kids):
                        leaf[r][page] += 1
                    continue
                groups = []
                for k in kids:
                    label = "#" if isinstance(k, str) else k.label
                    if not groups or groups[-1][0] != label:
                        groups.append((label, []))
                    groups[-1][1].append([k] if isinstance(k, str) else k.kids)
                style = tuple(g[0] for g in groups)
                styles[style].add(page)
                for g, (_, many) in enumerate(groups):
                    for j, inner in enumerate(many):
                        kids_of[style, g, "first" if j == 0 else "last" if j + 1 == len(many) else "other"].append((page, inner))
            m = sum(len(p) for p in styles.values())
            own = 1 - sum(len(p) * math.log(len(p)) for p in styles.values()) / m / math.log(m_all)
            entropies = [-sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values()) for c in leaf.values()]
            leaf_value = 1 - np.average(entropies, weights=[sum(c.values()) for c in leaf.values()]) / math.log(m_all) if leaf else None
            below = defaultdict(list)
            for (style, *name), inner in kids_of.items():
                value = visit((*path, style, *name), inner, inside)
                below[style].append((sum(1 for _ in {p for p, _ in inner}), *value))
            total, most = 0.0, 0.0
            for style, p in styles.items():
                if style is None:
                    v, top = (leaf_value, leaf_value) if len(p) > 1 else (1.0, 1.0)
                elif len(p) == 1:
                    v, top = 1.0, 1.0
                else:
                    v, top = sum(a * b for a, b, _ in below[style]) / sum(a for a, *_ in below[style]), max(c for *_, c in below[style])
                total, most = total + len(p) * v, max(most, top)
            share = html_text.DECAY ** len(styles)
            comp = (1 - share) * own + share * total / m
            if list(styles) == [None]:
                comp = leaf_value
            most = max(most, comp)
            if m > 1 and most < (min(html_text.LOW, math.log(2) / math.log(m_all)) if inside else html_text.LOW):
                low.add((host, inside, *path))
            return comp, most

        visit((), [(i, kids) for i, kids in enumerate(all_pages) if kids], zone)
    return low


def brute_text(url, page, low):
    inside, kids = html_text.read_page(page)
    host = html_text.host_of(url)

    def read(path, kids):
        if (host, inside, *path) in low:
            return []
        if all(isinstance(k, str) for k in kids):
            return list(kids)
        groups = []
        for k in kids:
            label = "#" if isinstance(k, str) else k.label
            if not groups or groups[-1][0] != label:
                groups.append((label, []))
            groups[-1][1].append([k] if isinstance(k, str) else k.kids)
        style = tuple(g[0] for g in groups)
        return [t for g, (_, many) in enumerate(groups) for j, inner in enumerate(many) for t in read((*path, style, g, "first" if j == 0 else "last" if j + 1 == len(many) else "other"), inner)]

    out = "\n".join(read((), kids))
    if not out and low:
        low = set()
        out = "\n".join(read((), kids))
    return out


def test_style_tree(spark):
    rng = random.Random(3)
    rows = site(24, rng) + [(400 + i, u, h) for i, u, h in site(3, rng, "small.example")] + [(100 + i, None, "<body><div>Home</div><p>same</p></body>") for i in range(6)]
    rows += [(200 + i, f"http://copies.example/{i}", "<body><div>all the same</div><p>on every page</p></body>") for i in range(6)]
    rows += [(None, "http://s.example/x", None), (300, "http://s.example/y", ""), (301, "not a url", "<p>x")]
    rows += [rows[3]]
    low = brute_low(rows)
    assert low
    want = sorted((str(i), brute_text(u, h, low)) for i, u, h in rows)
    for keys in (html_text.BROADCAST_KEYS, 0):  # both ways of bringing the keys to the pages
        got = html_text.extract(pages(spark, rows), keys)
        assert sorted((str(r.page_id), r.text) for r in got.collect()) == want
    found = dict(want)
    for i in range(24):
        assert "Home" not in found[str(i)] and "rights" not in found[str(i)] and "Subscribe" not in found[str(i)]
        assert found[str(i)].count(" ") >= 29
    assert "Home" in found["400"]  # three pages are no site
    assert found["200"] == "all the same\non every page"  # a page doesn't lose all its text
    assert found["100"] == "Home\nsame"  # no host, no tree


def test_copies_of_an_article_stay(spark):
    """A third of a host's pages are copies of one article; a menu is on all."""
    rows = [(i, f"http://h.example/{i}", f"<article><h1>T{i if i > 9 else ''}</h1><p>{'one text of many copies' if i < 10 else f'text {i} x{i} y{i} z{i}'}</p><p>read on in our great paper</p></article>") for i in range(30)]
    got = texts(html_text.extract(pages(spark, rows)))
    assert got[0] == "T\none text of many copies" and got[20] == "T20\ntext 20 x20 y20 z20"


def test_html_empty(spark):
    got = html_text.extract(pages(spark, []))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 0


# Operator 12

DOCS = "doc_id long, text string, n_words long, bucket long, place int, fit boolean"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, None) for r in rows], DOCS)


def brute_resample(rows, target, longest, buckets, percent, least):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    raw = [(i, *features(t)) for i, t in rows]
    s = Counter(b for *_, f in raw for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    out = []
    for i, words, f in raw:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("longest, buckets", [(1, 50), (2, 1000), (3, 10_000)])
def test_resample(spark, longest, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "ROWS", 7)  # several blocks a task
    rng = random.Random(5)
    words = ["The", "cat", "ÉTÉ", "été", "x1", "o'clock", "a-b", "日本", "\U0001f600"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "!?"), (None, "cat " * 30), (503, "the cat " * 5000)]
    target = ["the cat", "The CAT sat", None, "", "日本 cat"]
    got = resampling.resample(docs(spark, rows), docs(spark, [(None, t) for t in target]), longest, buckets, 25, 20)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_resample(rows, target, longest, buckets, 25, 20)


def test_feature_slices(monkeypatch):
    text = "aa bb cc dd " * 500
    want = resampling.feature_counts(text, 3, 1000)
    for size in (1, 5, 64):
        monkeypatch.setattr(resampling, "CHUNK", size)
        assert resampling.feature_counts(text, 3, 1000) == want
    assert want[0] == 2000 and sum(want[1].values()) == 2000 + 1999 + 1998


def test_resample_edges(spark):
    assert resampling.resample(docs(spark, []), docs(spark, [(1, "a")])).count() == 0
    twice = [(1, "word " * 20), (1, "word " * 20), (2, "other " * 20)]
    got = resampling.resample(docs(spark, twice), docs(spark, []), percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3] and {r.n_features for r in got} == {20}


# Operator 13

VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], VECTORS)


def brute_codes(rows, parts, entries, rounds):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) and abs(x) < vector_codes.LIMIT for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(fine[0][1])
    fine = [r for r in fine if len(r[1]) == dim]
    data = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in fine]
    cut = vector_codes.bounds(dim, parts)
    books = [[d[cut[p] : cut[p + 1]] for d in data[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, z, strict=True)), e) for e, z in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = defaultdict(list)
            for d in data:
                found[near(d[cut[p] : cut[p + 1]], books[p])[1]].append(d[cut[p] : cut[p + 1]])
            books[p] = [[sum(c) // len(c) for c in zip(*found[e], strict=True)] if e in found else z for e, z in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for z in b for x in z).encode()).hexdigest()
    out = []
    for (i, _, label), d in zip(fine, data, strict=True):
        got = [near(d[cut[p] : cut[p + 1]], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in got), sum(x for x, _ in got)))
    total = Counter()
    for _, label, _, e in out:
        total[label] += e
    return sorted(map(repr, ((i, c, e, total[label], digest) for i, label, c, e in out)))


@pytest.mark.parametrize("dim, parts, entries, rounds", [(8, 4, 16, 2), (7, 3, 5, 3), (4, 4, 64, 0), (6, 1, 256, 1), (2, 4, 8, 1)])
def test_codes(spark, dim, parts, entries, rounds, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    rng = random.Random(dim)
    rows = [(i, [rng.choice([-1, 1, 0.5]) * rng.choice([rng.random(), 0.25, 3000.0]) for _ in range(dim)], rng.choice([None, 1, 2, 2, 2])) for i in range(150)]
    rows += [(i, [0.5] * dim, 2) for i in range(200, 260)] + [(7, [0.125] * dim, None), (None, [0.25] * dim, 3), rows[3], rows[3]]
    rows += [(-1, None, 1), (-2, [None] * dim, 1), (-3, [math.nan] * dim, 1), (-4, [-math.inf] * dim, 1), (-5, [3e38] * dim, 1), (900, [0.5] * (dim + 1), 1), (901, [], 1)]
    for labels in (vector_codes.BROADCAST_LABELS, 0):
        got = vector_codes.encode(vectors(spark, rows).repartition(3), parts, entries, rounds, labels)
        assert sorted(repr(tuple(r)) for r in got.drop("label").collect()) == brute_codes(rows, parts, entries, rounds)


def test_filter_saves_work():
    """Whole subtrees are assigned: few of a tree's points are compared one by one."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 4))
    points = (centres[rng.integers(0, 16, 4096)] + rng.integers(-20, 20, (4096, 4))).astype(np.int64)
    t = vector_codes.Tree(points)
    book = centres.astype(np.int64)

    class Touched(np.ndarray):
        n = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Touched.n += len(key)
            return super().__getitem__(key)

    total, count = vector_codes.filtered(t.points.view(Touched), t.lo, t.hi, t.sums, book, assign=False)
    far = ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (np.bincount(far, minlength=16) == count).all() and (np.stack([points[far == e].sum(axis=0) for e in range(16)]) == total).all()
    assert Touched.n < len(points) // 4


def test_codes_edges(spark):
    assert vector_codes.encode(vectors(spark, [])).count() == 0
    assert vector_codes.encode(vectors(spark, [(1, None, 1)])).count() == 0
    got = vector_codes.encode(vectors(spark, [(1, [], 1), (2, [], None)]), parts=2).collect()
    assert {(r.code, r.error, r.label_error) for r in got} == {("0000", 0, 0)}
    with pytest.raises(ValueError):
        vector_codes.encode(vectors(spark, []), entries=257)


# Operators 1 and 5, mended


def test_any_number_of_languages(spark):
    """Profiles in several passes give what one pass gives; ties go to the first name."""
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(30)), f"l{i % 7}") for i in range(60)] + [(100, None, None), (101, "12", "l1"), (102, "zzz", None)]
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, _lang int, place int")
    learned = language_id.train_profiles(given, 50)
    once, many = (sorted(map(repr, language_id.identify(given, learned, 50, k).collect())) for k in (10_000, 2))
    assert once == many and len(once) == len(rows)


def test_no_copies_are_kept(spark):
    """Texts whose commonest shingle is the same, but little else; and texts that lose lines before they meet."""
    own = [" ".join(f"{k}{i}" for i in range(60)) for k in "abcd"]
    rows = [(1, "spam " * 90 + own[0]), (2, "spam " * 90 + own[1]), (3, "spam " * 49 + " ".join(own[2].split()[:21])), (4, "spam " * 49 + " ".join(own[0].split()[:21])), (5, own[3]), (6, own[3] + " end"), (7, "spam " * 80 + own[0])]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(given).collect()} == {1, 2, 3, 4, 5}


def test_failed_forests_lose_no_link(spark):
    """Chains of texts around the bar: classes are those of all pairs that reach it."""
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(120)]
        for k in range(9):
            own = list(words)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(120)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: top(i) for i in sets}
    got = {r.doc_id: r.component_id for r in simhash.near_classes(given, every=True).collect()}
    assert len(set(got.values())) > 12 and got == want
    # forests alone may part a class, never join two
    got = {r.doc_id: r.component_id for r in simhash.near_classes(given).collect()}
    assert all(want[i] == want[c] for i, c in got.items()) and sum(got[i] == want[i] for i in got) >= 0.9 * len(got)


# Operator 8


def test_sentences_of_any_script():
    words = "\u092f\u0939 \u090f\u0915 \u092a\u0942\u0930\u093e \u0935\u093e\u0915\u094d\u092f \u0939\u0948"
    line = f"{words} {words} {words}"
    assert quality_rules.line_fails(line, len(line.split()))
    for end in "\u0964\u061f\u06d4\u1362\u17d4\u3002\uff1f.":
        assert not quality_rules.line_fails(line + end, len(line.split()))


def test_repeat_words():
    def brute(words):
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)})

    rng = random.Random(9)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 40))]
        assert quality_rules.repeat_words(words) == brute(words)
    assert quality_rules.repeat_words([b"w%d" % (i % 70_000) for i in range(200_000)]) == 200_000
