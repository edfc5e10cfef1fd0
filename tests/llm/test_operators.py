"""Each operator on small fixtures: against brute force, with nulls, empty texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, ctw, decontaminate, html, language, near_dedup, packing, quality, substring, urls
from scriptorium.llm.components import components
from scriptorium.llm.queries import tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^ \t-\r]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed=3, n=60):
    """Invented prose with copies, near copies, shared passages, odd and empty texts, and nulls."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = " ".join(some(70))
    out = []
    for i in range(n):
        own = some(rng.randint(1, 150))
        if i % 7 == 3 and i > 7:
            own = words(out[i - 3] or "")
            if own:
                own[len(own) // 2] = "CHANGED"
        text = rng.choice([" ", "\n", " \t"]).join(own)
        if i % 9 == 4:
            text = f"{' '.join(own[:20])}\n{passage}\n{' '.join(own[20:40])}"
        out.append(text)
    out[5], out[6], out[8], out[9] = None, "", out[1], "   \n\t "
    out[11] = "　 wide space x y \x1c z"
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}" if i % 10 else None, len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "a b c d e f", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    return df.select("*", *(F.lit("x").alias(n) for n in names if n not in df.columns))


def test_quality(spark, docs, none):
    got = {r["doc_id"]: r for r in quality.judge(clashing(docs, "host", "n_words", "kept", "rate")).collect()}
    for i, t in enumerate(texts()):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        at = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if at[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        want = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again)
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert quality.judge(none).count() == 0


def test_quality_hosts(spark):
    rows = [(i, "good words here " * 1 + " ".join(map(str, range(30))), "en", "good", 1) for i in range(20)] + [(100 + i, "bad", "en", "bad", 1) for i in range(20)] + [(200, " ".join(map(str, range(40))), "en", "bad", 1)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0]["kept"] and not got[100]["kept"]
    assert not got[200]["failed"] and not got[200]["kept"]  # the host's verdict
    assert 0 < got[0]["host_rate"] < 0.5 < got[200]["host_rate"] < 1


def test_quality_repeats(spark):
    text = " ".join("a b c d e f g h".split() * 3) + "\nx\nx\n\n\n y"
    r = quality.judge(spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1)], DOCS)).collect()
    assert len(r) == 2 and r[0] == r[1]
    assert r[0]["n_repeat_words"] == 24 and r[0]["n_dup_lines"] == 1


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(words(texts()[2])[:30])), (2, None), (3, ""), (4, "wide space X y"), (5, "never seen at all in any text"), (1, " ".join(words(texts()[2])[:30]))], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.search(clashing(docs, "item_id", "containment"), clashing(bench, "doc_id")).collect())
    want = []
    for i, t in enumerate(texts()):
        for b in bench.collect():
            w, v = words(low(t)), words(low(b["text"]))
            k = min(5, len(v))
            own = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if v else set()
            if own and len(own & have) >= 0.8 * len(own):
                want.append((i, b["item_id"], len(own & have) / len(own)))
    assert got == sorted(want) and want
    many = decontaminate.search(docs, bench, block_items=2)
    assert sorted(map(tuple, many.collect())) == got
    assert decontaminate.search(none, bench).count() == 0 and decontaminate.search(docs, bench.limit(0)).count() == 0
    left = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert left == {None, *range(60)} - {i for i, _, _ in got}


def test_decontamination_ids(spark):
    """Rows go by their own text: with a null id, and beside a clean row of the same id."""
    item = "one two three four five six seven"
    rows = [(None, item), (None, "clean text"), (1, f"so {item} so"), (1, "other text"), (2, None)]
    bench = spark.createDataFrame([(1, item), (2, "not found in any of the rows")], "item_id bigint, text string")
    for size in (1, 50_000):
        got = decontaminate.clean(spark.createDataFrame(rows, "doc_id bigint, text string"), bench, block_items=size).collect()
        assert {tuple(r) for r in got} == {(None, "clean text"), (1, "other text"), (2, None)}


def brute_components(items, shingle, percent):
    sets = {}
    for i, t in items:
        w = words(low(t))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, docs, none):
    got = near_dedup.near_duplicates(clashing(docs, "rep", "component", "a", "b", "sig"), 3, 85).collect()
    want = brute_components(list(enumerate(texts())), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_large_group(spark):
    """A group larger than a region: copies of one text that differ from it in a few words each, so
    that two of them may be under the threshold."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    items = [(7, " ".join(base))]
    for i in range(8, 240):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(150)] = f"x{rng.random()}"
        items.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(items, "doc_id bigint, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(items, 3, 85)


def test_near_duplicates_tied_groups(spark):
    """Two large groups in common regions, tied by one pair: each member has more likely others in
    its own group than a list holds."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    places = [10 + 24 * k for k in range(12)]
    other = [f"v{i}" if i in places else w for i, w in enumerate(base)]
    between = [f"v{i}" if i in places[:4] else w for i, w in enumerate(base)]
    free = [i for i in range(4, 296) if all(abs(i - p) > 5 for p in places)]
    items = [(0, " ".join(other)), (1, " ".join(between))]
    for i in range(2, 300):
        own = list(base if i < 200 else other)
        own[rng.choice(free)] = f"x{i}"
        items.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(items, "doc_id bigint, text string"), 3, 85).collect()
    want = brute_components(items, 3, 85)
    assert {c for _, c in want.values()} == {0} and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("block", [4096, 64])
def test_near_duplicates_hot_region(spark, monkeypatch, block):
    """Pairs far apart in a region that passes batches, tasks and (64) blocks: a common template."""
    monkeypatch.setattr(near_dedup, "BLOCK", block, raising=False)
    base = [f"w{i}" for i in range(200)]
    tail = lambda i: [f"t{i % 160}x{k}" for k in range(15)] + [f"u{i}x{k}" for k in range(10)]
    items = [(i, " ".join(base + tail(i))) for i in range(320)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "32")
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(items, "doc_id bigint, text string"), 3, 85).collect()
    finally:
        spark.conf.set(batch, before)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 160 for i in range(320)}


def test_near_duplicates_repeated_id(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(30))), (1, " ".join(f"b{i}" for i in range(30))), (2, " ".join(f"b{i}" for i in range(30))), (3, " ".join(f"a{i}" for i in range(30)))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 4 and {r["component_id"] for r in got} == {1}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 101), (101, 102), (102, 103), (103, 104), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    up = {x: x for p in links if None not in p and p[0] != p[1] for x in p}
    for _ in up:
        for a, b in links:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


@pytest.mark.parametrize("window", [13, 50])
def test_substring(spark, docs, none, window):
    got = {r["doc_id"]: r for r in substring.remove(clashing(docs, "starts", "at", "cut", "anchor", "key", "words", "owner"), window).collect()}
    first = {}
    for i, t in enumerate(texts()):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    removed = 0
    for i, t in enumerate(texts()):
        w = words(t)
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        removed += len(gone)
    assert removed and got[None]["n_removed"] == 0
    assert substring.remove(none, window).count() == 0
    back = {r["doc_id"]: r for r in substring.remove(docs, window, keep="text", carry=("lang", "source")).collect()}
    for i, t in enumerate(texts()):
        assert back[i]["text"] == (t or "") or got[i]["n_removed"]
        assert hashlib.sha256(" ".join(words(back[i]["text"])).encode()).hexdigest() == got[i]["kept_sha256"]
        assert back[i]["_c0"] == "en"


def test_fm_index():
    rng = np.random.Generator(np.random.PCG64(4))
    text = np.concatenate([np.append(rng.integers(1, 6, 40), 0) for _ in range(30)])
    index = substring.FMIndex(text, 6, 5)
    at = np.array([i for i in range(len(text) - 4) if 0 not in text[i : i + 5]])
    got, lo, hi = index.search(text, at, 5)
    count = Counter(tuple(text[i : i + 5]) for i in at)
    assert {int(i): int(b - a) for i, a, b in zip(got, lo, hi)} == {int(i): count[tuple(text[i : i + 5])] for i in at if count[tuple(text[i : i + 5])] > 1}
    for i, a, b in zip(got, lo, hi):
        assert {tuple(text[j : j + 5]) for j in index.order[a:b]} == {tuple(text[i : i + 5])}


def test_tokenizer_matches(sf, spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer())
    own = packing.Encoder(tokenizer())
    some = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    some += ["", " ", "<|endoftext|> x", "<|endoftext|>", "x <|endoftext|>", "a  <|endoftext|>\n<|endoftext|> b", "<|endoftext", "日本語 テスト　x", "a" * 3000, " " * 3000, "it's I'LL we've\r\n\t x ", "👩‍👩‍👧 é é   \x1c\x85 ½ ²³ ०१"]
    for t in some:
        assert own(t) == slow.encode(t, add_special_tokens=False).ids


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, none):
    got = packing.pack_documents(clashing(docs, "length", "piece", "offset", "rank"), tokenizer(), 64, keep_ids=True).collect()
    assert check_packing(got, 64) >= -(-sum(r["length"] for r in got) // 64)
    encode = packing.Encoder(tokenizer())
    for i, t in [*enumerate(texts()), (None, "a b c d e f")]:
        ids = [*encode(t or ""), 2]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 64 for r in own[1:])
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack_documents(none, tokenizer()).count() == 0


def test_packing_plan():
    def least(count, capacity):
        """Bins that any packing needs, by trying all (small instances)."""
        items = sorted((s for s, n in count.items() for _ in range(n)), reverse=True)
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
                place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return best[0]

    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randint(5, 20)
        count = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        plan = packing.plan(dict(count), capacity)
        assert sum((Counter({s: own.count(s) * m for s in own}) for own, m in plan), Counter()) == count
        assert all(sum(own) <= capacity for own, _ in plan)
        fixed, left = packing.reduce_by_dominance(dict(count), capacity)
        # what is fixed costs nothing: the rest can be packed as well as the best packing of all
        assert sum(m for _, m in fixed) + least(left, capacity) == least(count, capacity)
    big = {s: rng.randint(1, 100_000) for s in range(1, 1025)}
    plan = packing.plan(big, 1024)
    used = sum(m for _, m in plan)
    assert used <= 1.005 * max(sum(s * n for s, n in big.items()) / 1024, sum(n for s, n in big.items() if s > 512))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home menu-open">
<header><p>Site header text that is long enough</p></header><nav><ul><li><a href=x>One</a><li>Two</ul></nav>
<div id="cookie-notice"><p>We use cookies on this long and boring page</p></div>
<main><div class="page-with-sidebar"><article class="post p12 has-sidebar post-comments"><h1>Title &amp; more</h1><p>First   para &lt;graph
 with <b>bold<br>break</b><p>Second &eacute;&#233;&#x41;<script>var x="</p>";</script> end
<ul><li>item one<li>item two</ul><aside>side</aside><form><input value=q><p>form text</p></form>
<div class="ad-slot">buy</div><p><span class="advert">Buy <span>now</span> cheap</span><ins class=adsbygoogle>x<p>&#x2014; third <span class="share-links">un closed</p><table><tr><td>c1<td>c2</table></article>
<section class="comments"><article class="comment"><p>A reader says very much about this article, on and on and on</p></article></section></main>
<footer><p>foot</p></footer></body>"""


def test_html(spark):
    rows = [(1, "http://A.com/x", PAGE), (2, "http://a.com/y", PAGE.replace("p12", "p99").replace("First", "Other")), (3, None, None), (4, "x", ""), (5, "http://b.com", "plain &amp text"), (6, "http://b.com", "<article><p>un closed &copy"), (1, "http://A.com/x", PAGE)]
    pages = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "host", "path", "text", "votes")
    got = [r.asDict() for r in html.main_text(pages).collect()]
    assert len(got) == 7
    by = {r["page_id"]: r for r in got}
    want = "Title & more\nFirst para <graph with bold break\nSecond ééA end\nitem one\nitem two\n— third\nc1\nc2"
    assert by[1]["text"] == want and by[1]["n_chars"] == len(want)
    assert by[2]["text"] == want.replace("First", "Other") and by[2]["path"] == by[1]["path"]
    assert by[3]["text"] == by[4]["text"] == "" and by[5]["text"] == "plain & text" and by[6]["text"] == "un closed ©"
    assert html.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("mark", ['<svg class="i"/>', '<object data="x"/>', "<video-js></video-js>", "<audio-player>", "<title-block>", "<canvas>", "<svg><svg>x</svg>x</svg>", "<video>x</video>", "<script>x</script>"])
def test_html_embedded(mark):
    assert html.extract(f"<article><p>a {mark} c</p><p>b</p></article>", None).split() == ["a", "c", "b"]


LONG = "word " * 40


def lines(page):
    return html.extract(page, None).split("\n")


def test_html_keeps_the_article():
    """Sections whose names may mean other things, headlines in an article's header, headings with ids,
    nested sections, a long quotation."""
    head = f"<body><header><p>Site</p></header><article><header><h1>Head</h1></header><p>lead</p><section class=intro><p>{LONG}</p></section>"
    more = f'<section class="discussion"><h2 id="discussion">Discussion</h2><p>Main finding</p></section><section class="related-work"><h2>Related</h2><p>Others</p></section><section class=body><p>{LONG * 4}</p><blockquote>{LONG * 9}</blockquote></section>'
    got = lines(head + more + '<div class="notice"><p>We use this.</p></div><div class="related"><h3>More</h3><ul><li><a href=x>one</a></ul></div><section class="comments"><p>c</p></section></article><footer><p>f</p></footer>')
    assert got == ["Head", "lead", LONG.strip(), "Discussion", "Main finding", "Related", "Others", (LONG * 4).strip(), (LONG * 9).strip()]


def test_html_wrappers():
    """A wrapper gives way to the container that holds most of it; one with text of its own doesn't."""
    got = lines(f"<body><div class=wrap><div class=teaser>other</div><div class=content><h1>T {LONG}</h1><p>{LONG}</p><div class=s>{LONG * 4}</div></div></div><p>tail</p>")
    assert got == [f"T {LONG}".strip(), LONG.strip(), (LONG * 4).strip()]


def test_html_votes(spark):
    """Votes by host against a count; of equal votes the longer path wins, then the one that sorts last."""
    page = "<body><div class={}><p>" + LONG + "</p></div>"
    rows = [("http://a.org/1", page.format("one")), ("http://a.org/2", page.format("two")), ("http://b.org/1", page.format("one")), ("http://b.org/2", page.format("longer")), ("http://c.org/1", page.format("x1")), ("http://c.org/2", page.format("x22")), ("http://c.org/3", page.format("zz")), (None, None)]
    got = {r["host"]: (r["path"], r["votes"]) for r in html.host_paths(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"a.org": ("body>div.two", 10**6), "b.org": ("body>div.longer", 10**6), "c.org": ("body>div.x#", 2 * 10**6)}


def test_html_consensus(spark):
    """A page whose own best container is another is read by its host's path."""
    good = "<body><div class=main><p>{}</p></div><div class=other><p>{}</p></div>"
    rows = [(i, "http://h.org/", good.format("long main text " * 9, "short")) for i in range(5)] + [(9, "http://h.org/", good.format("brief", "an unusually long other text " * 9))]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "brief" and got[0].startswith("long main")


def test_urls(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    at = ["http://a.Example.com/en/1?x=1#f", "https://www.example.com/en/", "http://x.net/es/", "http://x.net/ES/", "http://example.com?/en/", "example.com/en/", None, "http://xcom/en/", "://b.com/", "http://example.com/", "http://notexample.com/en/"]
    want = [("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("x.net", "/es/", "net/es/", "block"), ("x.net", "/ES/", None, "allow"), ("example.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("xcom", "/en/", None, "allow"), ("b.com", "/", "com/", "allow"), ("example.com", "/", "com/", "allow"), ("notexample.com", "/en/", "com/", "allow")]
    pages = clashing(spark.createDataFrame(list(enumerate(at)), "page_id bigint, url string"), "tokens", "rule", "_t", "confidence")
    labels = spark.createDataFrame([], "url string, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, labels, rules).collect()}
    assert got == dict(enumerate(want))
    assert urls.judge(pages.limit(0), labels, rules).count() == 0


def test_url_mining(spark):
    """Against all combinations of tokens, counted directly."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        host, part = rng.choice(["casino", "news", "shop"]), rng.choice(["win", "read", "sale"])
        bad = (host, part) == ("casino", "win") or (part == "sale" and rng.random() < 0.5)
        rows.append((i, f"http://{host}.org/{part}/{rng.randrange(99)}", bad))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, pages, [("allow", "none/")], 0.8).collect()}
    assert all((got[i] == "block") == ("casino.org/win" in u) for i, u, _ in rows)
    sets = [(tuple(r["t"]), r["bad"]) for r in pages.select(urls.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    count, ill = Counter(), Counter()
    for t, b in sets:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(t, k):
                count[c] += 1
                ill[c] += b
    rules = {c: ill[c] / count[c] for c in count if ill[c] >= 20 and ill[c] / count[c] >= 0.8}
    rules = {c: x for c, x in rules.items() if not any(set(d) < set(c) and y >= x for d, y in rules.items())}
    mined = urls.mine(pages.select(urls.tokens_of(F.col("url")).alias("tokens"), "bad"), 0.8, 20, 1.0)
    assert {tuple(r["tokens"]): (r["support"], round(r["confidence"], 9)) for r in mined.collect()} == {c: (ill[c], round(x, 9)) for c, x in rules.items()}


def test_url_mining_whole_urls(spark):
    """Tokens that come last in long urls count too, and tokens that come together cost nothing."""
    path = "/".join(f"part{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(f"http://a.org/{path}/{i}?{'zz' if i < 25 else 'yy'}=1", i < 25) for i in range(60)]
    rows += [(f"http://b.org/{path}?vv=1&ww=2" + "&uu=3" * (i % 2), i < 30) for i in range(40)] + [("http://b.org/?vv=1", False), ("http://b.org/?ww=1", False)] * 20
    tokens = spark.createDataFrame(rows, "url string, bad boolean").select(urls.tokens_of(F.col("url")).alias("tokens"), "bad")
    got = {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in urls.mine(tokens, 0.7, 20, 1.0).collect()}
    assert got[("q:zz",)] == (25, 1.0) and got[("q:vv", "q:ww")] == (30, 0.75) and got[("p:partaa", "q:vv")] == (30, 0.75)
    assert len(got) == 1 + 1 + 3 * 40


def test_url_mining_mixed(spark):
    """Against all combinations of tokens of random urls."""
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        t = sorted(rng.sample("abcdefghij", rng.randrange(1, 7)))
        rows.append((t, rng.random() < (0.95 if {"a", "b"} <= set(t) or "c" in t else 0.3)))
    count, ill = Counter(), Counter()
    for t, b in rows:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(t, k):
                count[c] += 1
                ill[c] += b
    rules = {c: ill[c] / count[c] for c in count if ill[c] >= 5 and ill[c] / count[c] >= 0.6}
    rules = {c: x for c, x in rules.items() if not any(set(d) < set(c) and y >= x for d, y in rules.items())}
    mined = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.6, 5, 1.0)
    assert {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in mined.collect()} == {c: (ill[c], x) for c, x in rules.items()}


def test_chat_round_trip():
    odd = ["", "\\", "\\\\### Assistant: </turn> ok", "</turn>\n<turn user>\n", "<turn", "\\<turn x>", "a\nb", "</turn", "\\n", "<", ">"]
    for turns in [[(r, t) for r in odd for t in odd]]:
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns and not spans
    formatted, spans = chat.render([("user", "x"), ("assistant", odd[3]), ("assistant", "é")])
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [odd[3], "é"]
    with pytest.raises(ValueError):
        chat.parse(formatted + "x")


def test_chat_fold(spark):
    log = [
        ("c", 1, 0, "message", "user", "hi"), ("c", 2, 1, "delta", "assistant", "He"), ("c", 3, 1, "delta", None, "llo"),
        ("c", 4, 2, "message", "user", "more"), ("c", 5, 1, "regenerate", None, None), ("c", 7, 1, "delta", None, "again"),
        ("c", 6, 1, "delta", None, "Once "), ("c", 8, 0, "edit", None, "hi!"), ("d", None, None, None, None, None), (None, 1, 1, "message", "assistant", "a"),
    ]
    events = clashing(spark.createDataFrame(log, "conv_id string, seq bigint, turn bigint, kind string, role string, text string"), "formatted", "loss_spans")
    got = {r["conv_id"]: (chat.parse(r["formatted"]), [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]) for r in chat.conversations(events).collect()}
    assert got == {"c": ([("user", "hi!"), ("assistant", "Once again")], ["Once again"]), "d": ([("", "")], []), None: ([("assistant", "a")], ["a"])}
    assert chat.conversations(events.limit(0)).count() == 0
    assert {r["n_turns"] for r in chat.digests(chat.conversations(events)).collect()} == {1, 2}


def test_language(spark, none):
    rng = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["ré", "su", "ton"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(k, 30), k, "s", 1) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    train = clashing(spark.createDataFrame([*rows, (99, None, "aa", "s", 1), (98, "x", None, "s", 1)], DOCS), "l", "t", "h")
    samples = language.fit(train)
    assert set(samples) == {"aa", "bb"}
    new = [(1, make("aa", 40)), (2, make("bb", 40).upper()), (3, None), (4, ""), (5, "12 -- 34"), (6, make("aa", 9000)), (7, "日本語"), (1, make("aa", 40))]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(clashing(spark.createDataFrame(new, "doc_id bigint, text string"), "score", "lang_pred"), samples).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "aa"] and got[3][1] == 0
    assert got[7][0] in samples and all(0 <= s <= 1 for _, s in got.values())
    assert language.predict(none, samples).count() == 0
    assert {r["lang_pred"] for r in language.predict(train, language.fit(none)).collect()} == {"und"}


def test_cross_parsing():
    """Phrases against a greedy parse by str.find."""
    rng = random.Random(1)
    sample = bytes(rng.choice([1, 2, 3, 0]) for _ in range(300))
    model = language.Model({"a": sample, "b": bytes([1, 2] * 50)})
    rows = [bytes(rng.choice([1, 2, 3, 0, 9]) for _ in range(n)) for n in (0, 1, 50, 2000)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    got = model.phrases(np.frombuffer(b"".join(rows), np.uint8), off)

    def parse(text, known):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in known:
                k += 1
            n, i = n + 1, i + k
        return n

    def cut(text):
        marks = [0]
        for k in range(1, max(1, -(-len(text) // language.STRETCH))):
            at = text.find(0, k * language.STRETCH)
            marks.append(len(text) if at < 0 else at)
        return [text[a:b] for a, b in zip(marks, [*marks[1:], len(text)])]

    for j, known in enumerate((sample, bytes([1, 2] * 50))):
        assert [int(x) for x in got[j]] == [sum(parse(part, known) for part in cut(text)) for text in rows]


def test_scores(spark, docs, none):
    train = F.col("doc_id") % 5 != 1
    got = {r["doc_id"]: r for r in ctw.score(clashing(docs, "grp", "kind", "keys", "score", "n_tokens"), F.coalesce(train, F.lit(True)), group_bytes=4000).collect()}
    items = [*enumerate(texts()), (None, "a b c d e f")]
    learn = [t for i, t in items if i is None or i % 5 != 1]
    count = Counter(w for t in learn for w in [*words(low(t)), None])
    n = sum(count.values())
    tree = brute_tree([(t or "").encode() for t in learn])
    for i, t in items:
        own = [*words(low(t)), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (len(count) + 1))) for w in own)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(brute_score(tree, (t or "").encode()), rel=1e-5)
    assert ctw.score(none, train).count() == 0
    unlearnt = ctw.score(docs, F.lit(False)).where("doc_id = 6").first()
    assert unlearnt["score"] == pytest.approx(8 * math.log10(0.5)) and unlearnt["train_tokens"] == 0


def contexts(text, depth=ctw.DEPTH):
    full = bytes([255] * depth) + text + b"\xff"
    for i in range(depth, len(full)):
        for k in range(8):
            yield full[i - depth : i], (1 << k) | full[i] >> (8 - k), full[i] >> (7 - k) & 1


def brute_tree(learn):
    """Node (context, prefix) -> zeros, ones; and L by recursion."""
    nodes = {}
    for t in learn:
        for c, u, bit in contexts(t):
            for d in range(ctw.DEPTH + 1):
                nodes.setdefault((c[ctw.DEPTH - d :], u), [0, 0])[bit] += 1
    children = {}
    for c, u in nodes:
        if c:
            children.setdefault((c[1:], u), []).append((c, u))
    mixed = {}

    def total(key):
        a, b = nodes[key]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        weight, out = 1.0, own
        if len(key[0]) < ctw.DEPTH:
            out = np.logaddexp(own, sum(map(total, children[key]))) - math.log(2)
            weight = math.exp(own - math.log(2) - out)
        mixed[key] = (b + 0.5) / (a + b + 1), weight
        return out

    for u in {u for c, u in nodes if not c}:
        total((b"", u))
    return mixed


def brute_score(mixed, text):
    out = 0.0
    for c, u, bit in contexts(text):
        p = None
        for d in range(ctw.DEPTH, -1, -1):
            node = mixed.get((c[ctw.DEPTH - d :], u))
            if node:
                p = node[0] if p is None else node[1] * node[0] + (1 - node[1]) * p
        p = 0.5 if p is None else p
        out += math.log10(p if bit else 1 - p)
    return out
