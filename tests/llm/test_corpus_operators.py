"""Each corpus operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows, extra
columns with clashing names, and without rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import ann, decontaminate, html_text, jaccard_join, license_scan, masked_lm, segment_sampling, substring_dedup, toxicity, url_filter
from ruleloom.llm.common import window_hashes
from ruleloom.llm.components import components
from tests.llm import brute

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(400)] + ["Über", "naïve,", "IT'S", "x"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, k, rng=RNG):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = "zz" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base, passage = prose(120, rng), prose(70, rng)
    docs = [(10, base), (3, base), (7, base.upper()), (4, None), (5, ""), (6, " \t\n "), (8, "one two"), (9, "ONE two"), (None, base), (8, "one two"), (12, "a" * 3000), (13, prose(9000, rng))]
    docs += [(20 + k, edited(base, k % 6, rng)) for k in range(30)]
    docs += [(60 + k, prose(30, rng) + " " + passage + "\n" + prose(20 + k, rng)) for k in range(8)]
    docs += [(80 + k, passage[: 200 + 10 * k]) for k in range(5)] + [(90, passage + " " + passage), (91, "same " * 130)]
    return docs


@pytest.fixture(scope="module")
def frame(spark, corpus):
    return spark.createDataFrame([(d, t, "en", k, "x") for k, (d, t) in enumerate(corpus)], "doc_id long, text string, n_words string, row int, component_id string").repartition(3)


def test_window_hashes_tell_windows_apart():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2], np.uint64)
    for width in range(1, 8):
        got = window_hashes(h, width)
        wins = [tuple(h[i : i + width]) for i in range(len(h) - width + 1)]
        assert [[a == b for a in wins] for b in wins] == [[a == b for a in got] for b in got]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            r, s = sorted((find(a), find(b)))
            up[s] = r
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bound", [0, 40])
def test_components_in_rounds(spark, bound):
    """More links than one task takes are connected in rounds, with or without a last task."""
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1100 - i, 1099 - i) for i in range(60)] + [(2000, 2000 + i) for i in range(30)] + [(2000 + i, 2000) for i in range(30)]
    want = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(5), task_links=bound).collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    assert {want[x] for x in range(1040, 1101)} == {1040} and {want[x] for x in range(2000, 2030)} == {2000}
    assert components(spark.createDataFrame([], "a long, b long"), task_links=bound).count() == 0


def test_components_of_few_links_take_few_tasks(spark):
    """Every task of a round leaves files, so rounds over few links filled the disk where partitions are many."""
    sc = spark.sparkContext
    sc.setJobGroup("few links", "")
    try:
        rows = components(spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long").repartition(5)).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
    assert {(r.node, r.component) for r in rows} == {(i, 0) for i in range(65)}
    assert sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s)) <= 40


@pytest.mark.parametrize("group", [256, 5])
def test_jaccard_join(spark, frame, corpus, group):
    want = brute.jaccard_components(corpus)
    rows = jaccard_join.join_documents(frame, group=group).collect()
    assert len(rows) == len(corpus)
    assert {(r.doc_id, r.component_id) for r in rows} == {(d, want.get(d)) for d, _ in corpus}
    assert sorted((r.doc_id or -1, r.n_shingles) for r in rows) == sorted((d or -1, len(brute.shingles(t))) for d, t in corpus)


def test_jaccard_join_keeps_one_of_each_group(spark, frame, corpus):
    want = brute.jaccard_components(corpus)
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1] + [d for d in want if want[d] == d])
    assert jaccard_join.join_documents(frame.limit(0)).count() == 0


def test_keep_one_keeps_unlike_rows(spark):
    """Unlike texts of one doc_id stay, equal ones once; columns may be called like the operator's own."""
    base = prose(50, random.Random(1))
    rows = [(1, "one thing entirely", "a", 1), (1, prose(30, random.Random(2)), "b", 2), (1, "one thing entirely", "c", 3), (2, base, "d", 4), (3, base + " more", "e", 5), (4, "", "f", 6), (4, None, "g", 7), (4, "", "f", 6), (None, base, "h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, component int").repartition(3)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.node, r.component) for r in kept.collect()) == [("a", 1), ("b", 2), ("d", 4), ("f", 6), ("g", 7), ("h", 8)]


def test_prefixes_of_similar_sets_share_enough():
    rng = random.Random(2)
    for _ in range(300):
        a = {rng.randrange(60) for _ in range(rng.randrange(1, 40))}
        b = {x for x in a if rng.random() < 0.9} | {rng.randrange(60) for _ in range(3)}
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        for wanted in (1, 2, 4):
            pre = [set(sorted(s)[: len(s) - jaccard_join.least_overlap(len(s)) + w]) for s, w in ((a, wanted), (b, 4))]
            m = min(wanted, 4)
            if m <= min(jaccard_join.least_overlap(len(a)), jaccard_join.least_overlap(len(b))):
                assert len(pre[0] & pre[1]) >= m


@pytest.mark.parametrize("bound", [substring_dedup.BROADCAST_BYTES, 0])
def test_substring_dedup(frame, corpus, bound):
    want = brute.substring_dedup(corpus)
    rows = {r.row: r for r in substring_dedup.dedup_substrings(frame, bound=bound).collect()}
    assert len(rows) == len(corpus)
    for k, (n, kept) in enumerate(want):
        r = rows[k]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept), brute.sha(kept)), corpus[k][0]
        assert r.text == (corpus[k][1] if n == len(kept) else b" ".join(kept).decode())
    assert sum(r.n_removed for r in rows.values()) > 500


def test_substring_dedup_of_nothing(frame):
    assert substring_dedup.dedup_substrings(frame.limit(0)).count() == 0
    out = substring_dedup.remove_repeats(frame.select("doc_id", "text", F.length("text").cast("long").alias("n_chars")))
    assert out.where("n_chars <> length(text)").count() == 0


def test_anchors_are_in_every_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    p, at = substring_dedup.anchors(h, 20, 4)
    for s in range(len(h) - 20 + 1):
        assert any(s <= a <= s + 16 for a in at)
        best = p[s : s + 17].min()
        assert best in p[at[(at >= s) & (at <= s + 16)]]


@pytest.mark.parametrize("bound", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination(spark, bound):
    rng = random.Random(4)
    items = [(1, prose(30, rng)), (2, "Short item here"), (3, None), (4, "!!!"), (None, prose(14, rng)), (2, "Short item here"), (10, prose(13, rng))]
    texts = [prose(40, rng), items[0][1], "pre " + items[0][1][5:] + " post", "a short ITEM, here and there", None, "", "...", prose(200, rng) + " " + items[6][1], items[4][1] + " " + items[4][1]]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id int, text string, n_hit string").repartition(2)
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = {r.doc_id: r for r in decontaminate.search_documents(docs, bench, bound=bound).collect()}
    for k, want in enumerate(brute.decontaminate(texts, items)):
        assert (found[k].n_words, found[k].n_hit, found[k]["items"]) == want
    assert [(m.item, m.item_word, m.word, m.size) for m in found[1].matches if m.item == "1"] == [("1", 0, 0, 30)]
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if not (r.n_hit and 20 * r.n_hit >= r.n_words)}
    assert decontaminate.search_documents(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.search_documents(docs.limit(0), bench).count() == 0


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(2)
    for top, n, width in ((2, 300, 13), (3, 40, 4), (50, 500, 5), (1, 30, 13), (2, 0, 3)):
        numbers = np.concatenate([rng.integers(0, top + 1, n), np.zeros(width, np.int64)])
        at = np.flatnonzero(numbers)
        order, suffixes = decontaminate.suffix_array(numbers, at, width)
        want = sorted(at.tolist(), key=lambda i: (numbers[i : i + width].tolist(), i))
        assert [numbers[i : i + width].tolist() for i in at[order]] == [numbers[i : i + width].tolist() for i in want]
        assert sorted(order) == list(range(len(at))) and (suffixes[1:] >= suffixes[:-1]).all()


def test_url_filter(spark, monkeypatch, tmp_path):
    urls = [
        "http://example.net/en/x", "http://EXAMPLE.net/de", "https://a.b.example.com/de/?q", "http://example.com/fr/", "http://x.org/fr/1#y", "http://x.org", "http://casino-win.example.org/en/",
        "http://badexample.net/en/", "no scheme", None, "", "http://", "a://b://c/net/", "http://net/", "http://x.net:80/", "http://m.spam-farm.example.net/en/z", "http://ÄB.net/ü",
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, urls[0]])], "page_id int, url string, rule string")

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in __import__("re").split("[/?#]", rest, maxsplit=1)[0])
        path = __import__("re").split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
        best = max(((len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES if fits(h, p)), default=None)
        listed = any(fits(h, p) for h, p, _ in url_filter.LISTED)
        return host, path, best and best[2], best[3] if best else "block" if listed else "allow"

    for bound in (url_filter.MAX_BYTES, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, max_bytes=bound).collect()}
        assert got == {i: judge(u) for i, u in enumerate([*urls, urls[0]])}
    lists = [spark.createDataFrame([*g, (None, "/", "block"), ("org", "/", "other")], "host string, path string, verdict string") for g in (url_filter.RULES, url_filter.LISTED)]
    for bound in (url_filter.MAX_BYTES, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, *lists, max_bytes=bound).collect()}
        assert got == {i: judge(u) for i, u in enumerate([*urls, urls[0]])}
        nothing = url_filter.filter_urls(df, [], [], max_bytes=bound).collect()
        assert len(nothing) == len(urls) + 1 and all(r.rule is None and r.verdict == "allow" for r in nothing)
    twice = url_filter.filter_urls(df, [], [("org", "", "allow"), ("org", "", "block")]).collect()
    assert {r.verdict for r in twice if r.host == "x.org"} == {"block"}
    # colliding digests are told apart by the stored strings
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s, seed=0: len(s) % 3)
    entries = [(h + p, len(h), k, v == "block") for k, g in ((0, url_filter.LISTED), (1, url_filter.RULES)) for h, p, v in g]
    path = tmp_path / "index"
    path.write_bytes(url_filter.packed(sorted(entries, key=lambda e: (len(e[0].encode()) % 3, e[0]))))
    index = url_filter.DigestArray(str(path))
    hosts, paths, rules, verdicts = zip(*map(judge, urls))
    assert url_filter.judge_batch(index, list(hosts), list(paths)) == (list(rules), list(verdicts))
    monkeypatch.undo()
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_license_scan(spark):
    texts = [
        "Released under the MIT License.", "x under the mit\nlicense under THE mit license", "Licensed under the Apache Licence, Version 2.0", "apache license version 2", "CC BY-NC 4.0 cc by nc", None, "", "plain words",
        "Licensd under the GNU General Publik License, version 3.", "licensed under the gnu general public license version 2", "under themit license", "cc by nc" * 2000,
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, score int")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = [x.decode() for x in brute.ALNUM.findall(brute.lower(t))]
        places = [(k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert rows[0].labels == "mit" and rows[2].labels == "apache-2" and rows[2].base_labels == "" and 0.8 < rows[2].score < 1
    assert rows[8].labels == "gpl-3" and rows[8].spans[0].edits == 2 and rows[8].spans[0].text == "licensd under the gnu general publik license version 3"
    assert (rows[8].spans[0].start, rows[8].spans[0].end) == (0, 8) and rows[9].labels == "gpl-2" and rows[7].score == 0


def test_license_seeds_lose_no_place():
    """The seeded search against the bounded-error pattern run over the whole text."""
    import regex

    rng = random.Random(8)
    notice = license_scan.Notice("licensed under the apache license version 2 0", "x", 12)
    for _ in range(60):
        t = list("licensed under the apache license version 2 0")
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(t))
            t[k] = rng.choice(["", "q", t[k] + "z"])
        text = f" {prose(6, rng).lower()} {''.join(t)} {prose(6, rng).lower()} ".encode()
        whole = regex.search(rb"(?b)(?:licensed under the apache license version 2 0){e<=3}", text)
        assert bool(notice.places(text)) == bool(whole)


def test_license_codes_and_versions_allow_no_edits():
    notices = [license_scan.Notice(t, label, license_scan.CHARS_PER_EDIT) for t, label in license_scan.NOTICES]
    labels = lambda t: license_scan.scan(t.encode(), notices)[5]
    for other in ("licensed under cc by sa 4.0", "licensed under cc by nd 4 0", "mozilla public license version 1.1", "licensed under the apache license version 1 1", "released under the mpl license"):
        assert labels(f"x {other} y") == "", other
    for own, label in (("licensd undr cc by nc 4 0", "cc-by-nc"), ("mozila public licence version 2.0", "mpl-2"), ("mozilla public license version 2", "mpl-2"), ("releasd under the mit licence", "mit")):
        assert labels(f"x {own} y") == label, own
    twice = license_scan.scan(b"mozila public license version 2 0 mozilla public license version 2 0", notices)[7]
    assert [s[1:4] for s in twice] == [(0, 5, 1), (6, 11, 0)]
    # an edited notice beside an exact one, in both orders, for every notice
    for text, label in license_scan.NOTICES:
        words = text.split()
        bent = " ".join([words[0][:-1], *words[1:]])
        for line, edits in ((f"{bent} {text}", [1, 0]), (f"{text} {bent}", [0, 1]), (f"{bent} {bent} {bent}", [1, 1, 1])):
            spans = license_scan.scan(line.encode(), notices)[7]
            n = len(words)
            assert [s[:4] for s in spans] == [(label, k * n, k * n + n - 1, e) for k, e in enumerate(edits)], line


def test_license_scan_is_linear(spark):
    """Ten megabytes of candidates take about ten times the time of one."""
    import time

    notices = [license_scan.Notice(t, label, license_scan.CHARS_PER_EDIT) for t, label in license_scan.NOTICES]
    took = []
    for n in (4_000, 40_000):
        start = time.process_time()
        got = license_scan.scan(b"cc by nc relased under the mit license " * n, notices)
        took.append(time.process_time() - start)
        assert got[0] == 8 * n and got[1] == 2 * n and len(got[7]) == n
    assert took[1] < 25 * took[0]
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><a>Home</a></nav>
<div class="promo-box banner">Buy</div><div class="x7">Subscribe to our letter today</div><article><h1>Head %d</h1><p><b>First   &amp; one %d<br>more<p>Second&nbsp;one %d</p><aside>side</aside>
<div class="comments"><p>me too</p></div></article><form><p>f</p></form><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    pages = [(i, f"http://h.example/{i}", PAGE % (i, i, i)) for i in range(8)] + [(50, "http://h.example/z", None), (51, None, "<p>a<p>b"), (52, "http://lone.example/", ""), (53, "http://h.example/0", PAGE % (0, 0, 0))]
    pages += [(54, "http://o.example/", "<body><main><p>cut &am"), (55, "http://o.example/2", "text < 5 and <b>bold</b> <i"), (56, "http://o.example/3", "<div><li>one<li>two</div><p>" + "long " * 5000)]
    df = spark.createDataFrame([(*p, "old") for p in pages], "page_id int, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(df, url_filter.host_of(F.col("url"))).collect()}
    for i in range(8):
        assert got[i].text == f"Head {i}\nFirst & one {i} more\nSecond one {i}" and got[i].n_chars == len(got[i].text)
    assert got[53].text == got[0].text
    assert (got[50].text, got[51].text, got[52].text, got[54].text) == ("", "a\nb", "", "cut &am")
    assert got[55].text == "text < 5 and bold" and got[56].text == "one\ntwo\n" + ("long " * 5000).strip()
    # without a site to learn from, the unmarked box stays
    assert "Subscribe" in html_text.main_text(PAGE % (1, 1, 1))
    assert html_text.extract_text(df.limit(0), F.lit("")).count() == 0


def test_style_tree_importance(spark):
    """Entropy by hand: a text on all pages has importance 0, texts of one page each have 1."""
    pages = [(f"<body><div class=a>always</div><div class=b>only {i}</div></body>",) for i in range(10)]
    df = spark.createDataFrame(pages, "html string").withColumn("host", F.lit("h"))
    nodes, _ = html_text.parse(pages[0][0])
    style = [html_text.signed(x) for x in html_text.style_nodes(nodes)]
    found = html_text.style_tree(df).first()
    assert set(found.low) == {s for s, n in zip(style, nodes) if n[2] == "a"}
    assert set(found.high) == {s for s, n in zip(style, nodes) if n[1] in ("html", "body") or n[2] == "b"}


def test_style_tree_against_plain_entropies(spark):
    """low, mid and high of random pages against entropies computed by dictionaries over paths of tags and names."""
    import math
    from collections import defaultdict

    rng = random.Random(13)

    def box(depth):
        name = rng.choice(["", " class=a", " class=b", " id=c"])
        if depth == 0 or rng.random() < 0.3:
            return f"<p{name}>{rng.choice(['one', 'two', 'three', f'new {rng.random()}'])}</p>"
        return f"<div{name}>{''.join(box(depth - 1) for _ in range(rng.randrange(1, 4)))}</div>"

    pages = {h: [f"<body>{''.join(box(2) for _ in range(3))}<article>{box(1)}</article></body>" for _ in range(n)] for h, n in (("h", 40), ("few", 4), ("g", 12))}
    df = spark.createDataFrame([(h, p) for h, ps in pages.items() for p in [*ps, ps[0]]], "host string, html string").repartition(3)
    got = {r.host: r for r in html_text.style_tree(df).collect()}
    assert set(got) == {"h", "g"}
    for host in got:
        texts, shows, on = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), defaultdict(set)
        style_of = {}
        distinct = sorted(set(pages[host]))
        for number, page in enumerate(distinct):
            nodes, blocks = html_text.parse(page)
            hashes = html_text.style_nodes(nodes)
            paths = [()]
            for parent, tag, names in nodes[1:]:
                paths.append((*paths[parent], (tag, names)))
            words, kids = defaultdict(list), defaultdict(list)
            for block in blocks:
                for n, t in block:
                    while n > 0:
                        words[n].append(t)
                        n = nodes[n][0]
            for i in range(1, len(nodes)):
                style_of[paths[i]] = html_text.signed(hashes[i])
                on[paths[i]].add(number)
                if nodes[i][0] > 0:
                    kids[nodes[i][0]].append(paths[i][-1])
            for i in range(1, len(nodes)):
                # the parts of a node's text count in the order of its tree, by node
                shape = tuple((paths[j], tuple(t for b in blocks for n, t in b if n == j)) for j in range(i, len(nodes)) if paths[j][: len(paths[i])] == paths[i] and (j == i or _under(nodes, j, i)))
                if words[i]:
                    texts[paths[i]][tuple(x[1] for x in shape if x[1])].add(number)
                if kids[i]:
                    shows[paths[i]][tuple(k for m, k in enumerate(kids[i][::-1]) if m == 0 or kids[i][::-1][m - 1] != k)].add(number)
        want = {"low": set(), "mid": set(), "high": set()}
        for path, found in texts.items():
            if len(on[path]) < html_text.MIN_PAGES:
                continue
            m = max(len(on[path]), 2)
            content = 1 - sum(math.log(len(x)) for x in found.values()) / len(found) / math.log(m)
            mixed = content
            if shows[path]:
                counts = [len(x) for x in shows[path].values()]
                total = sum(counts)
                look = sum(-c / total * math.log(c / total) for c in counts) / math.log(total) if total > 1 else 1.0
                mixed = (1 - 0.9 ** len(counts)) * look + 0.9 ** len(counts) * content
            limit = html_text.THRESHOLD_ARTICLE if any(t == "article" for t, _ in path) else html_text.THRESHOLD
            value = max(mixed, content)
            want["low" if value < limit else "mid" if value * html_text.WEAK < limit else "high"].add(style_of[path])
        assert {k: set(getattr(got[host], k)) for k in want} == want


def _under(nodes, j, i):
    while j > i:
        j = nodes[j][0]
    return j == i


def test_style_tree_decides_without_names(spark):
    """Boxes, menus and inline adverts that recur on a host go by their entropy, with names switched off too."""
    page = """<body><nav><a>Home</a></nav><div class="q1">Call <i>us</i> now</div><div class="legal side"><h2>Law %d</h2><p>Only %d &lt;here&gt; <span class="zz">buy this</span>
    and <b>there</b></p><span class="y%s">kept %d</span></div><div id="q2"><p>last line</p></div></body>"""
    rows = [(i, f"http://h.example/{i}", page % (i, i, "", i), "x", 1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, nodes string, _host int, _low int").repartition(3)
    host = url_filter.host_of(F.col("url"))
    for names in (True, False):
        got = {r.page_id: r for r in html_text.extract_text(df, host, names=names).collect()}
        for i in range(12):
            assert got[i].text == f"Law {i}\nOnly {i} <here> and there\nkept {i}", names
            assert (got[i].nodes, got[i]._host, got[i]._low) == ("x", 1, 2)
    off = html_text.extract_text(df, host, names=False, tree=False).collect()
    assert all("Call us now" in r.text and "buy this" in r.text and "Home" in r.text for r in off)


def test_names_are_a_prior(spark):
    """A name alone removes a box that no host knows, but neither an article nor what it stands in; deep pages stay linear."""
    text = html_text.main_text
    assert text("<nav>menu</nav><div class='legal'><article><p>body</p></article></div><div class='notice'>n</div>") == "body"
    assert text("<div class='tags'><p>a long text that is most of the page</p></div><div class='tags'>x</div>") == "a long text that is most of the page"
    assert text("<p>see <span class='advert'>buy</span> this</p><div class='comments'><p>me</p></div>") == "see this"
    assert text("<div class='comments'><p>me</p></div>", names=False) == "me"
    deep = 20_000
    assert text("<div>" * deep + "x" + "</div>" * deep + "</i>" * deep + "<p>y</b>" * deep).startswith("x\ny")
    html_text._features("<div class=a>" * deep + "x" + "</p>" * deep)


def test_repeated_pages_keep_their_text(spark):
    """Pages that all occur many times give the tree and the texts of the same pages once; so does one copied page."""
    page = "<body><div class=a>always</div><p>only %d</p><article><p>inner %d</p></article></body>"
    for copies in ([6] * 7, [6, 1, 1, 1, 1, 1, 1]):
        rows = [(i, "http://h.example/", page % (i, i)) for i, n in enumerate(copies) for _ in range(n)]
        df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
        got = html_text.extract_text(df, url_filter.host_of(F.col("url"))).collect()
        assert len(got) == len(rows) and all(r.text == f"only {r.page_id}\ninner {r.page_id}" for r in got)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    x[5] = x[100]
    x[7] *= 1e-30
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] + [1.0] * 31), (1003, [None] + [1.0] * 31), (1004, [1.0, 2.0]), (1050, [2.0, 4.0]), (None, [1.0] * 32), (100, x[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (ann.BLOCK, 7):
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        u = x / np.abs(x).max(1, keepdims=True)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        hit = 0
        for q in range(0, 600, 50):
            s = u @ u[q]
            want = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 13), i))[:5]
            own = sorted(got[q])
            assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
            assert all(abs(score - s[i]) < 1e-12 for _, i, score in own)
            hit += len({i for _, i, _ in own} & set(want))
        assert hit >= 0.9 * 60
        assert sorted(got[1050]) == [(1, 1004, pytest.approx(1.0))] and set(got) == {*range(0, 600, 50), 1050}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    pair = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(pair, F.col("vec_id") == 0).collect()] == [(0, 1, 0.0)]


def test_repeated_ids_take_one_place_each(spark):
    """Ids that occur more than k times, alike or with other vectors, leave the other places to other ids."""
    base = np.random.default_rng(4).normal(size=16)
    tilt = lambda e: (base + e * np.eye(16)[3]).tolist()
    rows = [(0, base.tolist())] + [(7, tilt(0.01))] * 9 + [(8, tilt(0.02 + 0.01 * n)) for n in range(7)] + [(9 + n, tilt(0.2 + 0.1 * n)) for n in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (ann.BLOCK, 4):
        for tables in (ann.TABLES, 1):
            got = sorted((r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0, block=block, tables=tables).collect())
            assert got == [(1, 7), (2, 8), (3, 9), (4, 10), (5, 11)]
    vid = np.array([7] * 5 + [8, 9, 10, 11])
    v = np.array([tilt(0.1 * n) for n in range(9)])
    _, ids, s = ann.best_in_block(np.array([0]), base[None], vid, v, 5)
    assert ids.tolist() == [7, 8, 9, 10, 11] and s[0] == pytest.approx(1.0)


def test_pseudo_rotations_keep_lengths_and_concatenated_hashes_work():
    x = ann.unit(np.random.default_rng(0).normal(size=(50, 24)))
    r = ann.rotated(x, 1, 0, 3)
    assert r.shape == (50, 32) and np.allclose((r * r).sum(1), 1)
    for cells in ((None,), (None, None), (None, 4), (None, 64, 2)):
        assert (ann.probed(x, 0, cells, 4, 3)[:, 0] == ann.buckets(x, 0, cells, 3)).all()
    assert [ann.cells_for(n) for n in (100, 10_000, 52_000, 10**6)] == [(None,), (None, 2), (None, 8), (None, 64)]


def test_nearest_neighbours_in_finer_cells(spark):
    """Recall of the operator against brute force where cells are split, at fewer comparisons than all pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    u = ann.unit(x.astype(float))
    found = {(r.query_id, r.vec_id) for r in got}
    near = {(q, int(i)) for q in range(0, 9000, 50) for i in np.argsort(-(u @ u[q]))[1:6]}
    assert len(found & near) >= 0.9 * len(near) and len(got) == len(near)
    cells = ann.cells_for(9000)
    seen = sum(np.isin(ann.buckets(u, t, cells, 11), p).sum() for t in range(ann.TABLES) for p in ann.probed(u[:5], t, cells, ann.probes_for(cells, 64), 11))
    assert cells == (None, 2) and seen / 5 < 0.8 * 9000


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["idiot", "moron", "scumbag", "worthless"]
    docs, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        w = [rng.choice(WORDS[:200]) for _ in range(rng.randrange(5, 120))]
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    docs += [(None, None, "x"), (9000, "", "x"), (9001, "you id1ot, you morron", "x"), (9002, "w1 w2 w3", "x")]
    labels += [(None, 1), (3, None), (9002, None)]
    df = spark.createDataFrame(docs, "doc_id int, text string, score string")
    known = spark.createDataFrame(labels, "doc_id int, toxic int")
    model = toxicity.fit(df, known)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(df.withColumn("h", toxicity.held_out()), model).collect()}
    held = [i for i in range(700) if rows[i].h]
    assert np.mean([rows[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert rows[9001].predicted == 1 and rows[9002].predicted == 0 and all(0 <= r.score <= 1 for r in rows.values())
    kept = toxicity.remove_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in rows.values())
    nothing = toxicity.fit(df, known.limit(0))
    assert toxicity.score_toxicity(df, nothing).agg(F.max("predicted")).first()[0] == 0


def test_toxicity_training_uses_the_whole_embedding():
    """Trained embeddings have more than one direction, and misspellings that training never saw gain from shared n-grams."""
    rng = random.Random(5)
    bad = ["idiot", "moron", "scumbag", "worthless"]
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(WORDS[:200]) for _ in range(rng.randrange(5, 80))]
        if i % 2:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w).encode())
        labels.append(i % 2)
    model = toxicity.train(texts, labels)
    singular = np.linalg.svd(model.embedding, compute_uv=False)
    assert (singular > 0.1).sum() > 1 and model.weights.shape == (toxicity.DIM, 2)
    scorer = toxicity.Scorer(*model.collapsed())
    plain, *spelt = scorer.score([b"w1 w2 w3 w4 w5 w6", b"w1 w2 idiott w4 w5 w6", b"w1 w2 morron w4 w5 w6", b"w1 w2 worthlesss w4 w5 w6"])
    assert plain < 0.5 and all(s > 0.5 for s in spelt)


def test_toxicity_scores_against_plain_sums(spark):
    """The score of every text from the model's embedding and softmax, one passage at a time; held_out by zlib."""
    import zlib

    rng = random.Random(7)
    texts = [prose(rng.randrange(1, 40), rng) for _ in range(30)] + ["", None, "same same same", "a" * 50_000, prose(9000, rng), "...", "\ud7ff x"]
    labelled = [t.encode() if t else t for t in texts[:20]]
    model = toxicity.train(labelled, [i % 2 for i in range(20)], steps=5)

    def plain(text):
        words = [(w, toxicity.features([w])[0]) for w in (text or "").encode().split()]
        means = [model.embedding[g].mean(0) if i == 0 or words[i - 1][0] != w else 0 * model.embedding[0] for i, (w, g) in enumerate(words)]
        n = toxicity.PASSAGE
        best = -np.inf
        for a in range(max(1, len(means) - n + 1)) if means else []:
            z = np.mean(means[a : a + n], 0) @ model.weights
            best = max(best, z[1] - z[0])
        z = (best if means else 0.0) + model.bias[1] - model.bias[0]
        return 1 / (1 + np.exp(-z))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = toxicity.score_toxicity(df.withColumn("h", toxicity.held_out()), model).collect()
    for r in rows:
        assert r.score == pytest.approx(plain(texts[r.doc_id]), abs=1e-4), r.doc_id
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (5000 if i == 3 else 5)) for i in range(40)] + [(1, "short"), (1, "a longer text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    one_class = toxicity.fit(docs, labels.where("toxic = 1"))
    assert toxicity.score_toxicity(docs, one_class).agg(F.min("score")).first()[0] > 0.999
    assert toxicity.fit(docs, labels, sample=3).embedding.shape[0] == 1 << toxicity.BITS
    assert toxicity.fit(docs, labels, chars=0).embedding.shape[0] == 1


def test_segment_sampling(spark):
    texts = ["Hello world, again", "  two  spaces\n\nline", "日本語 ▁ 😀\x00é", "", None, "a", "▁", "word " * 3000, "Hello world, again", "\ud7ff\ue001"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, ids string").repartition(3)
    rows = segment_sampling.sample_segmentations(df, k=3).collect()
    pieces = segment_sampling.Pieces(segment_sampling.MODEL)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=segment_sampling.MODEL)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert pieces.decode(r.ids) == (texts[r.doc_id] or "")
        assert library.decode(list(r.ids)) == (texts[r.doc_id] or "")
    assert set(by) == set(range(len(texts)))
    for own in by.values():
        assert len({tuple(r.ids) for r in own}) == len(own) <= 3 and [r.sample for r in sorted(own, key=lambda r: -r.gumbel)] == list(range(1, len(own) + 1))
    assert len(by[3]) == len(by[4]) == 1 and by[4][0].inclusion == 1 and len(by[7]) == 3
    again = segment_sampling.sample_segmentations(df.repartition(1).orderBy("doc_id"), k=3).collect()
    assert {(r.doc_id, r.sample, tuple(r.ids)) for r in again} == {(r.doc_id, r.sample, tuple(r.ids)) for r in rows}
    assert segment_sampling.sample_segmentations(df.limit(0)).count() == 0


def test_no_piece_crosses_a_cut_and_units_make_up_the_text():
    pieces = segment_sampling.Pieces(segment_sampling.MODEL)
    for p in pieces.weights:
        text = p.replace(segment_sampling.SPACE, " ")
        whole = pieces.units([text])[0]
        assert p in "".join(whole) and any(p in u for u in whole), p
    texts = ["a_{b} ->_ x².y", None, "", "two  spaces ▁ 日本"]
    units, counts = pieces.units(texts)
    assert counts.tolist()[1:3] == [0, 0] and sum(counts) == len(units)
    assert "".join(units[: counts[0]]) == "▁a_{b}▁->_▁x².y"
    lat = segment_sampling.Lattices(pieces)
    starts = lat.starts(pieces.units(["_{"])[0])
    got = segment_sampling.sample(lat.ready(), starts, 3, 200)
    assert pieces.weights["▁_{"][0] in {i for ids, *_ in got for i in ids.tolist()}


def test_encode_and_decode(spark):
    texts = ["Hello world, again", "naïve Über 日本 x_{1}", "", None]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    coded = segment_sampling.encode(df)
    back = {r.doc_id: r for r in segment_sampling.decode(coded.withColumnRenamed("text", "before")).collect()}
    assert [back[i].text for i in range(4)] == [t or "" for t in texts] and back[2].ids == back[3].ids == []
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=segment_sampling.MODEL)
    assert back[0].ids == library.encode(texts[0]) and segment_sampling.encode(df.limit(0)).count() == 0


def test_segmentations_follow_their_probabilities():
    pieces = segment_sampling.Pieces(segment_sampling.MODEL)
    lat = segment_sampling.Lattices(pieces)
    starts = lat.starts(pieces.units(["hello"])[0])
    every = {tuple(i.tolist()): float(np.exp(lp)) for i, lp, _, _ in segment_sampling.sample(lat.ready(), starts, 1, 500)}
    assert abs(sum(every.values()) - 1) < 1e-9
    n = 3000
    first, both = {}, {}
    drawn = segment_sampling.sample_many(lat.ready(), [(starts, segment_sampling.row_key(i, 1)) for i in range(n)], 2)
    for got in drawn:
        first[tuple(got[0][0].tolist())] = first.get(tuple(got[0][0].tolist()), 0) + 1
        for x in got:
            both[tuple(x[0].tolist())] = both.get(tuple(x[0].tolist()), 0) + 1
    for s, p in every.items():
        inclusion = p + sum(q * p / (1 - q) for t, q in every.items() if t != s)
        assert abs(first.get(s, 0) / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-3
        assert abs(both.get(s, 0) / n - inclusion) < 4 * (inclusion * (1 - inclusion) / n) ** 0.5 + 2e-3


def test_masked_lm(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["the cat sat", "a dog ran", "old trees grow"]) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    docs += [(None, None), (1000, ""), (1001, "?!"), (1002, "sat the cat ran a dog grow old trees sat a ran the"), (1003, "the cat sat a dog ran old trees grow the cat sat a"), (1003, "the cat sat a dog ran old trees grow the cat sat a")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id int, text string, pll string").repartition(3)
    tokens, p = masked_lm.fit(df, groups=4, slots=5, classes=4, rounds=3)
    rows = masked_lm.score_documents(df, (tokens, p)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and by[1000].n_tokens == 0 and by[1000].pll == 0 and by[1001].mean_pll is None
    assert by[1003].mean_pll > by[1002].mean_pll and by[1003].mean_pll > -np.log(tokens.size)
    ids = tokens(docs[3][1].encode())
    around = masked_lm.contexts(ids, tokens.size)
    total = 0.0
    share = lambda z: np.exp(z) / np.exp(z).sum()
    for i, row in zip(ids, around):
        h = np.tanh(p[0][row].reshape(-1).astype(float) @ p[1] + p[2])
        k = i % 4
        total += np.log(share(h @ p[3] + p[4])[k] * share(h @ p[5][k] + p[6][k])[i // 4])
    assert all(i < 20 for i in ids)
    assert abs(by[3].pll - total) < 1e-3 * abs(total)
    empty = masked_lm.fit(df.limit(0))
    assert masked_lm.score_documents(df, empty).count() == len(docs) and masked_lm.score_documents(df.limit(0), (tokens, p)).count() == 0


def test_masked_lm_trains_on_every_position():
    """Each position is a target in exactly one round, whatever the number of rounds."""
    for count in (1, masked_lm.ROUNDS, 5):
        got = np.concatenate([masked_lm.masked(1000, 77, turn, count) for turn in range(count)])
        assert sorted(got) == list(range(1000))


def test_masked_lm_tells_the_words_of_a_class_apart(spark):
    """Rare words by their counts within the class; with these the probabilities of all words sum to one."""
    docs = [(i, "the cat " * 20 + " ".join(["often"] * 6 + ["seldom"] * 2 + [f"once{i}"])) for i in range(10)]
    df = spark.createDataFrame(docs + [(3, docs[3][1])], "doc_id long, text string").repartition(3)
    tokens, p = masked_lm.fit(df, groups=1, slots=2, classes=1)
    assert set(tokens.known) == {b"the", b"cat"} and tokens.totals.tolist() == [11 * 9]
    asked = ["often", "seldom", "once3", "once4", "neverseen", "the", "often seldom", "often", None, "?"]
    rows = masked_lm.score_documents(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(2), (tokens, p)).collect()
    assert len(rows) == len(asked)
    pll = {r.doc_id: r.pll for r in rows}
    total = 11 * 9 + 1
    alone = masked_lm.contexts(tokens(b"often"), tokens.size)
    share = masked_lm.log_probabilities(p, tokens(b"often"), alone)[0]
    for i, c in enumerate([66, 22, 2, 1, 1]):
        assert pll[i] == pytest.approx(share + np.log(c / total), abs=1e-6)
    assert pll[7] == pll[0] and pll[8] == pll[9] == 0
    words = np.exp(share) * (66 + 22 + 2 + 9 + 1) / total + np.exp(masked_lm.log_probabilities(p, np.array([0, 1]), np.repeat(alone, 2, 0))).sum()
    assert words == pytest.approx(1, abs=1e-5)


def test_masked_lm_joins_only_words_beyond_the_head(spark, monkeypatch):
    """Whatever the size of the head, from no words to all, documents score the same, and words of the head aren't joined."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 80))) + f" once{i}") for i in range(60)]
    docs += [(100, docs[3][1]), (101, None), (102, "w1 never w59 w59")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = masked_lm.fit(df, groups=2, slots=4, classes=2)
    tokens = model[0]
    count = {bytes(r.word): r.n for r in tokens.counts.collect()}
    found, joined = [], []
    for most in (0, 20, masked_lm.HEAD):
        monkeypatch.setattr(masked_lm, "HEAD", most)
        least, common, logs = masked_lm.head(tokens.counts)
        assert set(common) == {w for w, n in count.items() if n >= max(least, 2)} and len(common) <= most
        assert np.array_equal(logs, np.round(np.log([float(count[w]) for w in common]) * masked_lm.GRID).astype(np.int64))
        shipped = spark.sparkContext.broadcast((model, common, logs))
        joined.append(masked_lm.rest_of_documents(df, tokens, "text", least, shipped).agg({"_logs": "sum"}).first()[0] or 0)
        found.append(sorted(map(tuple, masked_lm.score_documents(df, model).drop("text").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(docs)
    assert joined[0] > joined[1] > joined[2] == 0


def test_masked_lm_gradients():
    rng = np.random.default_rng(0)
    p = [x.astype(np.float64) for x in masked_lm.initial(2, 3, 2, [5, 4, 3, 2, 1], [4, 0])]
    ids, around = rng.integers(0, 5, 9), rng.integers(0, 9, (9, 4))
    ids[-2:] = 6, 7
    loss = lambda q: -np.mean(masked_lm.log_probabilities(q, ids, around))
    trainer = masked_lm.Trainer(p, 1.0)
    before = [x.copy() for x in trainer.square]
    trainer.step(ids, around)
    for k, (old, new, square) in enumerate(zip(p, trainer.p, trainer.square)):
        g = (old - new) * np.sqrt(square)
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        q = [x.copy() for x in p]
        q[k][i] += 1e-5
        r = [x.copy() for x in p]
        r[k][i] -= 1e-5
        assert abs((loss(q) - loss(r)) / 2e-5 - g[i]) < 1e-3 * abs(g[i]) + 1e-6
    assert all((b <= s).all() for b, s in zip(before, trainer.square))


def test_masked_lm_steps_in_and_out_of_bounds():
    """Probabilities and gradients are the plain softmax's whether or not the logits' maximum is taken off, also where no word has a group."""
    rng = np.random.default_rng(2)
    at, values = rng.integers(0, 300, 1000), rng.normal(size=(1000, 3))
    want = np.zeros((301, 3))
    np.add.at(want, at, values)
    assert np.allclose(masked_lm.summed_rows(at, values, 301), want)
    log_share = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for scale, only in ((1, None), (300, None), (1, 7), (300, 7)):
        p = [x.astype(np.float64) for x in masked_lm.initial(2, 3, 2, [6, 5, 4, 3, 2, 1], [4, 9])]
        p[3] *= 100 * scale
        p[5] *= 100 * scale
        assert masked_lm.is_bounded(p) == (scale == 1)
        ids, around = rng.integers(0, 8, 50) if only is None else np.full(50, only), rng.integers(0, 9, (50, 4))
        got = masked_lm.log_probabilities(p, ids, around)
        for i, row, lp in zip(ids, around, got):
            h = np.tanh(p[0][row].reshape(-1) @ p[1] + p[2])
            k = i % 2 if i < 6 else i - 4
            plain = log_share(h @ p[3] + p[4])[k] + (log_share(h @ p[5][k] + p[6][k])[i // 2] if i < 6 else 0)
            assert lp == pytest.approx(plain, rel=1e-9, abs=1e-9)
        trainer = masked_lm.Trainer(p, 1e-3)
        for _ in range(20):
            trainer.step(ids, around)
        assert masked_lm.log_probabilities(trainer.p, ids, around).mean() > got.mean()


def test_pipeline_runs_on_edges(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(12)
    base = prose(80, rng)
    rows = [(1, base, "en", "s", len(base)), (2, base, "en", "s", len(base)), (3, None, None, None, None), (4, "", "en", "s", 0), (None, prose(60, rng), "en", "s", 1), (5, prose(70, rng) + " " + base, "de", "s", 9), (5, prose(10, rng), "de", "s", 9)]
    bench = [(1, prose(20, rng)), (2, None)]
    rows.append((6, bench[0][1], "en", "s", 5))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = [r.doc_id for r in docs.collect()]
    assert sorted(x or 0 for x in ids) == [0, 1, 3, 4, 5, 5]  # both texts of document 5 are its own
    out = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(ids)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept: planted toxic texts go, the others match plain re-statements."""
    import corpus_pipeline as C

    rng = random.Random(21)
    bad = ["idiot", "moron", "scumbag", "worthless"]
    docs, toxic = [], {}
    for i in range(240):
        w = prose(rng.randrange(12, 90), rng).split(" ")
        toxic[i] = int(i % 3 == 0)
        if toxic[i]:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
    passage, item, base = prose(60, rng), prose(30, rng), prose(100, rng)
    docs += [(300 + i, f"{prose(20, rng)} {passage} {prose(20, rng)}") for i in range(4)] + [(400, f"{item} {prose(9, rng)}"), (401, f"{prose(300, rng)} {item[:40]}"), (402, None), (403, ""), (404, "a" * 5000)]
    docs += [(500 + i, edited(base, i, rng)) for i in range(6)]
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()] + [(500 + i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frames, now = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        frames.append(now)
    texts = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:-1]]
    caught = [i for i, y in toxic.items() if y and i not in texts[0]]
    assert len(caught) >= 76 and len([d for d, _ in docs if not toxic.get(d) and d not in texts[0]]) <= 3
    groups = brute.jaccard_components(list(texts[0].items()))
    assert set(texts[1]) == {d for d in texts[0] if groups[d] == d} and texts[1].items() <= texts[0].items() and {501, 502}.isdisjoint(texts[1])
    order = list(texts[1].items())
    want = {d: t if n == len(kept) else b" ".join(kept).decode() for (d, t), (n, kept) in zip(order, brute.substring_dedup(order))}
    assert texts[2] == want and texts[2] != texts[1]
    order = list(texts[2].items())
    clean = {d: t for (d, t), (n, hit, _) in zip(order, brute.decontaminate([t for _, t in order], [(1, item)])) if not (hit and 20 * hit >= n)}
    assert texts[3] == clean and 400 not in clean
    pieces = segment_sampling.Pieces(segment_sampling.MODEL)
    rows = frames[4].collect()
    assert {r.doc_id for r in rows} == set(clean) and all(pieces.decode(r.ids) == (clean[r.doc_id] or "") for r in rows)
    again = C.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.sample, tuple(r.ids)) for r in again} == {(r.doc_id, r.sample, tuple(r.ids)) for r in rows}
