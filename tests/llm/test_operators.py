"""Operators against brute force, and the odd rows that every one of them must take."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlens.llm import decontamination, embeddings, html, minhash, mixing, quality, sharding, suffixtree, urls, warc
from coverlens.llm.common import components

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, lang string"


def words(text):
    return (text or "").encode().lower().split()


def documents(seed=1, n=60):
    """Random documents, copies of them with a few words changed, and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            copy = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))))
    texts += [None, "", " \t\n", "One two", "one TWO", "a b éÉ", "x " * 20000]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en" if i % 2 else None) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, "no id at all here", None, None)]


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    found = components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in found.collect()} == groups(nodes, [p for p in pairs if p[0] != p[1]])


# --- sharding


def test_hypergeometric_has_the_right_distribution(spark):
    total, marked, drawn = 40, 13, 17
    numbers = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    draws = spark.range(40000).select(sharding.hypergeometric(*numbers, (F.col("id") + 0.5) / 40000).alias("k"))
    found = {r.k: r["count"] / 40000 for r in draws.groupBy("k").count().collect()}
    for k in range(14):
        expected = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        assert found.get(k, 0) == pytest.approx(expected, abs=1e-4)


def test_shards_are_exact_and_uniform(spark):
    df = spark.range(0, 20003, numPartitions=7).withColumns({"shard": F.lit("mine"), "At": F.lit(1)})
    out = sharding.shard(df, 6, range_rows=900).toPandas()
    assert sorted(out.id) == list(range(20003)) and set(out.columns) == {"id", "At", "shard", "slot"}
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 6
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    # Neighbours in the input spread evenly: each tenth of the ids over shards and over the halves of a shard.
    out["cell"] = out.shard * 2 + (out.slot * 2 >= sizes[out.shard].to_numpy())
    counts = out.groupby([out.id // 2001, "cell"]).size().unstack(fill_value=0).iloc[:-1].to_numpy()
    expected = counts.sum() / counts.size
    assert ((counts - expected) ** 2 / expected).sum() < counts.size + 5 * math.sqrt(2 * counts.size)


# --- quality


@pytest.mark.parametrize("sf, least", [(SF, 0.9), ("/root/testdata/sf0.1", 0.97)])
def test_quality_by_held_out_accuracy(spark, sf, least):
    """From some 270 labels, and from some 2,700."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    found = quality.judged(docs, labels.where("doc_id % 3 <> 0")).join(held, "doc_id")
    right = found.agg(F.avg((F.col("accepted") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > least


def test_sparse_sites_shrink_toward_their_hosts(spark):
    rows = [(i, "good words here" if i % 2 else "%%% bad $$$ &&&", "big", "a") for i in range(200)]
    rows += [(1000 + i, "%%% bad $$$ &&&", "bad", "a") for i in range(100)] + [(2000, "%%% bad $$$ &&&", "new", "a")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    found = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), labels)
    share = {r.source: r.site_share for r in found.select("source", "site_share").distinct().collect()}
    assert share["bad"] < share["new"] < 0.5 and share["bad"] < 0.1 < share["big"]


# --- near duplicates


def test_near_duplicates_against_brute_force(spark):
    rows = [r for r in documents(3, 150) if r[0] is not None]
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    assert len(links) > 30
    expected = groups(sets, links)
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], r.doc_id == expected[r.doc_id])
    kept = minhash.deduplicated(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "source", "lang"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


# --- decontamination


@pytest.mark.parametrize("block_words", [60, 10_000])
def test_contamination_against_brute_force(spark, block_words):
    """Also with items that are longer than a block."""
    rng = random.Random(8)
    rows = [r for r in documents(5, 80) if r[0] is not None]
    long_texts = [r[1] for r in rows if len(words(r[1])) > 30]
    items = [(i, " ".join(t.split(" ")[rng.randrange(5) :][:20])) for i, t in enumerate(long_texts[:12])]
    items += [(20, "One, TWO!"), (21, "..."), (22, None), (3, items[3][1]), (23, " ".join(long_texts[:4]))]
    found = decontamination.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    windows = {}
    for i, t in items:
        w = decontamination.normal_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for r in found.collect():
        w = decontamination.normal_words(r.text)
        hit, of = set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    of |= ids
        listed = ",".join(sorted(map(str, of)))
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(of))
        assert r.items_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        spanned = [x for s in r.hit_spans for x in decontamination.normal_words(r.text[s.begin : s.end])]
        assert len(spanned) == len(hit)


# --- pages


def test_alignment_is_longest(spark):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = html.shared(a, b)
        assert len(places) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in places)  # in the other's order


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><header><h1>Head &amp;\n line</h1></header><p>One<br>two <b>three</b>"
        "<p>Caf&eacute;&nbsp;x <form>Name</form><div class=ad>Buy</div><p><p> last &am</p><div id='comments'><p>Nice!</p></div></article>"
        "<aside>Side</aside><footer>&copy;</footer>"
    )
    plain = "<body><div>Top line</div><p>Own text {}</p><p>Shared by all</p><div>End line</div>"
    rows = [(1, "http://a.org/x", page), (2, "http://a.org/y/1", plain.format(1)), (3, "http://a.org/y/2", plain.format(2)), (4, None, None), (5, "http://b.org/", "")]
    out = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out == {1: "Head & line\nOne two three\nCafé x\nlast &am", 2: "Own text 1", 3: "Own text 2", 4: "", 5: ""}


def test_aliases_and_copies_keep_their_text(spark):
    """Neither another address of a page nor a copy of it, equal or nearly, shows its text to be a template."""
    plain = "<body><div>Top line</div><p>{}</p><p>Shared by all</p><div>End line</div>"
    text = "".join(f"<p>A long line of text number {i} about this and that" for i in range(20))
    urls_ = ["http://a.org/x", "https://a.org/x", "https://a.org/x?utm_source=feed", "http://a.org/x/print", None, None]
    rows = [(i, u, plain.format("Own text" + ("" if u else str(i // 9)))) for i, u in enumerate(urls_)]
    rows += [(10 + i, f"http://b.org/y{i}", plain.format(t + text)) for i, t in enumerate(("Monday", "Tuesday", "Tuesday"))]
    rows += [(20, "http://b.org/z", plain.format("Other")), (21, "http://c.org/1", plain.format("One" + text)), (22, "http://c.org/2", plain.format("Two" + text))]
    rows += [(30 + i, f"http://d.org/{i}", plain.format(i) + "<p>" + "Long template " * 30) for i in range(12)]
    rows += [(50, "http://e.org/x", plain.format("Own text")), (51, "https://e.org/x", plain.format("Own text")), (52, "http://e.org/other", plain.format("Other"))]
    out = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    body = "".join(f"\nA long line of text number {i} about this and that" for i in range(20))
    whole = "Top line\n{}\nShared by all\nEnd line"
    assert [out[i] for i in range(6)] == [whole.format("Own text")] * 4 + [whole.format("Own text0")] * 2
    assert [out[i] for i in (10, 11, 12, 20)] == ["Monday" + body, "Tuesday" + body, "Tuesday" + body, "Other"]
    assert [out[i] for i in (21, 22)] == [whole.format("One" + body), whole.format("Two" + body)]
    assert [out[30 + i] for i in range(12)] == [str(i) for i in range(12)]
    assert [out[i] for i in (50, 51, 52)] == ["Own text", "Own text", "Other"]


@pytest.mark.parametrize("page, expected", [
    ("<article><p>Hello <span class=ad>x<div>Buy</div></span> world</article>", ["Hello", "world"]),
    ("<article><p>Text <span class='share'>Share</p><p>next</article>", ["Text", "next"]),
    ("<article><ul><li class=ad>Buy<li>One<li>Two</ul><p class=promo>Offer<h2>Part</h2><p>End</article>", ["One", "Two", "Part", "End"]),
    ("<article><table><tr><td>a<td class=ad>b<td>c<tr><td>d</table></article>", ["a", "c", "d"]),
    ("<article><ul><li>One<ul><li>Inner</ul><li>Two</ul></article>", ["One", "Inner", "Two"]),
    ("<article><p>x" + " y" * 50_000 + "</article>", ["x" + " y" * 50_000]),
    ("<article><p>One <span class=ad>x <span>y</span> z</span> two</article>", ["One two"]),
    ("<article>Text</article><article class='comment odd'>Nice!</article><article class=post-comments-open>More</article>", ["Text", "More"]),
    ("<div class=has-sidebar><article><div class=entry-header><h1>Title</h1></div><p>Text</article></div><div class=sidebar>x</div>", ["Title", "Text"]),
])
def test_surroundings_end_where_their_element_does(page, expected):
    assert [text for text, _ in html.lines(page)] == expected


def test_aliases_share_a_block_but_not_an_allow(spark):
    rows = [
        (1, "http://a.net/p", '<link rel="canonical" href="http://x.com/de/1">'),
        (2, "https://a.net/p?utm_source=z#q", None),
        (3, "http://b.org/", '<meta http-equiv="refresh" content="0; url=http://a.net/p">'),
        (4, "http://c.net/", "x"), (5, None, None), (6, "no scheme", None), (7, "HTTP://A.Example.ORG/es/q?u=1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.verdicts(pages, urls.page_edges(pages)).collect()}
    assert out == {
        1: ("a.net", "/p", None, "block"), 2: ("a.net", "/p", None, "block"), 3: ("b.org", "/", "org/", "allow"),
        4: ("c.net", "/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("a.example.org", "/es/q", "example.org/es/", "block"),
    }


@pytest.mark.parametrize("target, expected", [
    ("http://x.com/de/1", "http://x.com/de/1"), ("//x.com/de/1", "https://x.com/de/1"), ("/de/1", "https://a.net/de/1"),
    ("page.html", "https://a.net/d/page.html"), ("../de/1", "https://a.net/de/1"), ("../../../de/./1", "https://a.net/de/1"),
    ("?id=2&amp;n=3", "https://a.net/d/p?id=2&n=3"), ("/r?u=http://x.com/", "https://a.net/r?u=http://x.com/"),
    ("/q?a=1&#38;section=2&copy=3&eacute;&#xe9", "https://a.net/q?a=1&section=2&copy=3éé"), ("#top", "https://a.net/d/p?q=1#top"),
    ("mailto:x@a.net", None), ("//[x", None), ("", None),
])
def test_targets_are_resolved(target, expected):
    assert urls.resolved("https://a.net/d/p?q=1", target) == expected
    assert urls.resolved("no scheme", "page.html") is None


def test_blocks_reach_aliases_by_relative_targets(spark):
    rows = [
        (1, "http://a.com/x/p", '<link rel="canonical" href="../de/1">'), (2, "http://b.net/x", "<link rel=canonical href='//c.com/de/1'>"),
        (3, "http://d.net/q?id=1", '<link rel="canonical" href="?id=2&amp;n=3">'), (4, "http://d.net/q?id=2&n=3", '<meta http-equiv="refresh" content="0; url=//e.com/de/">'),
        (5, "http://f.com/x", '<base href="/de/"><meta http-equiv=refresh content="0;url=page.html">'), (6, "http://g.com/de", '<link rel="canonical" href="page.html">'),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = {r.page_id: r.verdict for r in urls.verdicts(pages, urls.page_edges(pages)).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_loser_tree():
    rng = random.Random(6)
    for k in range(12):
        runs = [sorted((rng.randrange(9), i) for _ in range(rng.randrange(6))) for i in range(k)]
        merged = list(warc.LoserTree(runs, lambda x: (x[0],)))
        assert merged == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1]))


def test_archives_round_trip(spark, tmp_path):
    body = "<p>\r\n\r\nWARC/1.1 é" + "x" * 200
    rows = [(5, "http://b.org/1", body), (3, "http://a.org/2", body), (3, "http://a.org/2", body), (4, None, None), (6, "u\nv", "short"), (7, "q", "short"), (None, "http://a.org/0", body)]
    out = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path)).collect()
    digest = hashlib.sha256(body.encode()).hexdigest()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in out) == sorted(
        [(5, len(body.encode()), "revisit", 3), *[(3, len(body.encode()), "response", None)] * 2, (4, 0, "response", None),
         (6, 5, "response", None), (7, 5, "response", None), (0, len(body.encode()), "revisit", 3)],
        key=lambda x: (x[0], x[1]),
    )
    assert {r.payload_digest for r in out if r.page_id in (3, 5, None)} == {digest}
    ordered = sorted(out, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(rows)))
    assert [r.url_key for r in ordered] == sorted(r.url_key for r in out)


# --- vectors


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = [(base[i % 40] + rng.normal(size=16) * (0.05 + 0.3 * (i % 5) / 5)).astype(np.float32).tolist() for i in range(160)]
    rows = [(i, v, i % 3 if i % 11 else None) for i, v in enumerate(vectors)]
    rows += [(200, vectors[1], 1), (201, vectors[1], 1), (202, [0.0] * 16, 1), (203, None, 1), (204, [float("nan")] * 16, 1), (205, [None] * 16, 1), (206, [1.0], 1), (207, [], 1)]
    good = {i: np.array(v) for i, v, g in rows if v and None not in v and np.isfinite(v).all() and any(v) and g is not None}
    label = {i: g for i, _, g in rows}
    links = [
        (a, b) for a in good for b in good
        if a < b and label[a] == label[b] and len(good[a]) == len(good[b])
        and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= 0.93
    ]
    expected = groups([r[0] for r in rows], links)
    degree = Counter(x for pair in links for x in pair)
    out = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile=16)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == {i: (degree[i], expected[i]) for i, *_ in rows}


def test_error_bound_holds():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(200, 8)) ** 3, rng.normal(size=(200, 8)) ** 3
    exact = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    for least in (-0.5, 0.0, 0.5, 0.9):
        i, j = embeddings.possible(embeddings.quantised(x), embeddings.quantised(y), least)
        assert set(zip(*np.nonzero(exact >= least))) <= set(zip(i, j))


# --- language model


def test_scores_against_brute_force(spark):
    rows = [r for r in documents(7, 80) if r[0] is not None][:-2]
    tokens = {i: [*words(t), None] for i, t, *_ in rows}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for r in suffixtree.scored(spark.createDataFrame(rows, DOCS)).collect():
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(base) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.score <= 0 and math.isfinite(r.score)


def suffix_tree(rows, depth):
    """Each row's score by dictionaries: runs of words, and the states by the words before."""
    texts = [words(r[1]) + [None] for r in rows]
    train = [t for r, t in zip(rows, texts) if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10]
    runs = Counter(tuple(t[i : i + n]) for t in train for n in range(1, depth + 2) for i in range(len(t) - n + 1))
    total, distinct = sum(map(len, train)), sum(len(r) == 1 for r in runs)
    states = {}

    def probability(context, word, p):
        for n in range(1, len(context) + 1):
            if context[-n:] in states:
                backing, whole = states[context[-n:]]
                seen = runs[context[-n:] + (word,)]
                p = ((seen if seen >= 2 else 0) + backing * p) / whole
        return p

    for n in range(1, depth + 1):
        after = {}
        for run, seen in runs.items():
            if len(run) == n + 1 and seen >= 2:
                after.setdefault(run[:-1], {})[run[-1]] = seen
        found = {}
        for context, named in after.items():
            all_, kept = runs[context], sum(named.values())
            p = {w: probability(context[1:], w, runs[w,] / total) for w in named}
            gain = sum(x * math.log(x / all_ / p[w]) for w, x in named.items())
            if all_ > kept:
                gain += (all_ - kept) * math.log((all_ - kept) / all_ / max(1 - sum(p.values()), 1e-12))
            if gain > 0.5 * (len(named) + 1) * math.log(max(all_, 2)):
                found[context] = all_ - kept + len(named), all_ + len(named)
        states.update(found)
    floor = total + 0.1 * (distinct + 1)
    scores = [sum(math.log10(probability(tuple(t[max(i - depth, 0) : i]), w, (runs[w,] + 0.1) / floor)) for i, w in enumerate(t)) for t in texts]
    return scores, states


@pytest.mark.parametrize("depth", [1, 2, 3, 5, None])
def test_rare_contexts_count_however_long_the_corpus_is(spark, monkeypatch, depth):
    """The states are those of the dictionaries; contexts that occur two or three times are among them beside 400,000 other
    tokens. Without a depth the tree ends where the dictionaries retain nothing: a mark seven words back tells what comes."""
    told = [(0, f"{mark} cc dd ee ff gg hh {end}") for mark, end in (("aa", "yes"), ("bb", "no")) for _ in range(9)]
    told += [(0, " ".join("cc dd ee ff gg hh".split()[i:])) for i in range(6) for _ in range(3)]
    rows = [(i, r[1], None, None) for i, r in enumerate(documents(6, 40) + told + [(0, "aa bb cc dd")] * 3 + [(0, "x y " * 200_000)])]
    monkeypatch.setattr(suffixtree, "BUCKET", 50_000)
    scores, states = suffix_tree(rows, depth or 9)
    levels = {len(c) for c in states}
    assert (b"aa",) in states and len(states) > 50 and levels == set(range(1, min(depth or 9, max(levels)) + 1))
    assert depth or 7 <= max(levels) < 9
    found = {r.doc_id: r.score for r in suffixtree.scored(spark.createDataFrame(rows, DOCS).repartition(3), depth).collect()}
    assert [found[r[0]] for r in rows] == pytest.approx(scores)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    hashes = np.sort(rng.integers(1 << 63, size=999, dtype=np.uint64) * np.uint64(2))
    assert (suffixtree._hashes(suffixtree._ascending(hashes), 999) == hashes).all()
    for values in (np.zeros(0, np.int64), np.array([-1, 1 << 40]), rng.normal(size=(5, 7)), np.arange(9, dtype=np.int32)):
        back = suffixtree._unpacked(suffixtree._packed(values), values.size, values.dtype)
        assert (back == values.reshape(-1)).all()


def test_scoring_leaves_the_session_as_it_was(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, tables = spark.conf.get(name, None), len(spark.catalog.listTables())
    suffixtree.scored(spark.createDataFrame(documents(3, 5), DOCS), 1)
    assert spark.conf.get(name, None) == before and len(spark.catalog.listTables()) == tables


def test_states_are_distributions():
    """Named words and the rest share each retained state's mass: with the root's probabilities, they sum to 1."""
    tree = suffixtree.Tree(np.arange(2, 6, dtype=np.uint64), np.array([50, 30, 15, 5]), 100)
    tree.grow(np.array([0 << 32 | 1, 0 << 32 | 2, 1 << 32 | 0]), np.array([40, 8, 28]))
    assert (tree.sums[0] > 0).any()
    root = np.array([50, 30, 15, 5]) / 100
    for context in np.flatnonzero(tree.sums[0] > 0):
        p = tree.step(0, np.full(4, context), np.arange(4), root)
        assert p.sum() == pytest.approx(1.0)


# --- rows that everything must take


OPERATORS = {
    "shard": lambda spark, docs: sharding.shard(docs, 3),
    "mix": lambda spark, docs: mixing.mix(docs),
    "judged": lambda spark, docs: quality.judged(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")),
    "near": lambda spark, docs: minhash.near_duplicates(docs),
    "contamination": lambda spark, docs: decontamination.contamination(docs, spark.createDataFrame([], "item_id long, text string")),
    "scored": lambda spark, docs: suffixtree.scored(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = documents(9, 12)
    clashing = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("Size", "rate", "evidence", "slot", "hit_mask", "n_words", "key")})
    found = OPERATORS[name](spark, clashing).collect()
    ids = Counter(r.doc_id for r in found)
    assert len(found) == len(rows) and ids == Counter(r[0] for r in rows)
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).collect() == []
    # The columns that clash change nothing that the operator computes.
    plain = OPERATORS[name](spark, spark.createDataFrame(rows, DOCS)).columns
    assert set(plain) <= set(found[0].asDict())


PAGES = {
    "verdicts": lambda pages: urls.verdicts(pages, urls.page_edges(pages)),
    "extracted": lambda pages: html.extracted(pages),
    "archived": lambda pages: warc.archived(pages),
}


@pytest.mark.parametrize("name", PAGES)
def test_odd_pages(spark, name):
    schema = "page_id long, url string, html string"
    rows = [(1, "http://a.org/x", "<p>a"), (1, "http://a.org/x", "<p>a"), (None, None, None), (2, "no scheme", ""), (3, "http://a.org/y", "<p>" + "x " * 50_000)]
    extra = {c: F.lit(c) for c in ("Host", "text", "key", "gone", "found_key", "node", "digest", "archive", "position")}
    found = PAGES[name](spark.createDataFrame(rows, schema).withColumns(extra)).collect()
    assert Counter(r.page_id for r in found) == Counter(r[0] for r in rows)
    assert PAGES[name](spark.createDataFrame([], schema)).collect() == []


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(None, [1.0, 0.0], 1), (20, [1.0, 0.0], None), (9, [2.0, 0.0], 1)]
    found = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, schema).withColumn("cid", F.lit("x"))).collect()
    assert len(found) == len(rows)
    linked = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in found if r.n_links)
    assert linked == [(0, 4, 7), (7, 4, 7), (8, 4, 7), (9, 4, 7), (9, 4, 7)]
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0


def test_one_row_of_each_group_stays_whole(spark):
    text = "one two three four five six"
    rows = [(4, text, "a", "x"), (2, text.upper(), "b", "y"), (2, text.upper(), "b", "y"), (None, text, "c", "z"), (7, "", "d", "w"), (8, None, "e", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, kept_id string")
    assert sorted(map(tuple, minhash.deduplicated(docs).collect())) == [(2, text.upper(), "b", "y"), (7, "", "d", "w"), (8, None, "e", "v")]


def test_rows_without_words_all_stay(spark):
    rows = [(None, None, "a", "x"), (None, None, "b", "y"), (None, "", "a", "x"), (None, "", "b", "x"), (3, " \n", "a", "x"), (3, " \n", "b", "x"), (3, " \n", "b", "x")]
    docs = spark.createDataFrame([*rows, (5, "w", "a", "x"), (5, "w", "a", "x")], DOCS)
    assert sorted(map(repr, map(tuple, minhash.deduplicated(docs).collect()))) == sorted(map(repr, [*rows, (5, "w", "a", "x")]))


def test_sample_is_bounded_though_an_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"good text {i}") for i in range(50)] + [(2, "bad"), (3, "worse")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels, sample=3).prior == pytest.approx(math.log(2 / 3))


def test_mixing_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i < 3000 else "b" if i < 3300 else None, "en") for i in range(4000)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS))
    by = {r.source: r for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()}
    assert by["b"].t == 3 * by["b"].s and by["b"].taken == by["b"].t
    assert sum(r.t for r in by.values()) == pytest.approx(sum(r.s for r in by.values()))
    assert all(abs(r.taken - r.t) < 0.05 * r.t for r in by.values())
    assert mixing.emitted(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


# --- tags and nesting in pages


@pytest.mark.parametrize(
    "tag",
    ["p title=it's", 'p title="it\'s"', "p title='a \"b\" c'", "p title = 'x>y'", 'p title="x>y"', "p it's", 'p data-x=5"', "p x=a=b", "p class=\"x", "p =", "p title=", "P CLASS=x'y", "p a='b'c", "p/"],
)
def test_quotes_open_values_only_behind_equals_signs(tag):
    page = f"<article><{tag}>First paragraph of text.</p><p>Second one isn't short.</p><p>Third.</p></article>"
    assert [t for t, _ in html.lines(page)] == ["First paragraph of text.", "Second one isn't short.", "Third."]


def test_a_value_that_is_closed_later_ends_there():
    assert [t for t, _ in html.lines('<p class="x>a</p><p title="b">c</p>d')] == ["c", "d"]


def test_deep_nesting_takes_linear_time():
    import time

    def seconds(n):
        page = "<div>x" * n + "</span>" * n + "</div>" * n + "y"
        start = time.process_time()
        found = html.lines(page)
        assert len(found) == n + 1 and found[-1] == ("y", False)
        return time.process_time() - start

    small, large = min(seconds(5_000) for _ in range(3)), seconds(80_000)
    assert large < 16 * 4 * small
