"""The queries that SQL can't express, on the smallest driver tables, against brute force."""

from __future__ import annotations

import html
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import language, queries

from . import brute
from .test_operators import brute_components, check_packing, low, words


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op2(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    t.encode_special_tokens = True
    got = queries.op2_packing(spark, sf).collect()
    used = check_packing(got, 1024)
    assert used <= 1.05 * sum(r["length"] for r in got) / 1024 + 1
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(docs)
    for i, r in docs.items():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, p in enumerate(sorted(by[i], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_op3(spark, sf):
    """The driver's pages have one article each, of h1 and p."""
    got = {r["page_id"]: r for r in queries.op3_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n".join(x for x in blocks if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_op6(spark, sf):
    """Rules, and the verdicts of what no explicit rule decides, from all combinations of tokens; on tables
    that have enough pages for rules."""
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r["page_id"]: r for r in queries.op6_url_filter(spark, sf).collect()}
    labels = {r["doc_id"]: bool(r["toxic"] == 1 or r["quality"] == 0) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    told: dict[str, bool] = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r["doc_id"] in labels and r["text"]:
            head = r["text"][:60]
            told[head] = told.get(head, False) or labels[r["doc_id"]]

    def tokens(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
        if not m:
            return ()
        plain = lambda x: re.sub(r"\d+", "#", x.lower())
        parts = ["h:" + plain(x) for x in low(m[1]).split(".")] + ["p:" + plain(x) for x in m[2].split("/")] + ["q:" + x.split("=")[0].lower() for x in re.split("[&;]", m[3] or "")]
        return tuple(sorted({x for x in parts if len(x) > 2}))

    count, ill, n, n_bad, mine = Counter(), Counter(), 0, 0, {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [(len(rule), rule, act) for act, rule in queries.URL_RULES for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        _, rule, act = max(fits, default=(0, None, None))
        own = got[r["page_id"]]
        assert (own["host"], own["path"], own["rule"]) == (host, path, rule)
        if act:
            assert own["verdict"] == act and own["mined"] is None
        else:
            mine[r["page_id"]] = set(tokens(r["url"]))
        headline = re.search("(?s)<h1>(.*?)</h1>", r["html"])
        bad = act == "block" if act else told.get(html.unescape(headline[1])) if headline else None
        if bad is not None and tokens(r["url"]):
            n, n_bad = n + 1, n_bad + bad
            for k in range(1, len(tokens(r["url"])) + 1):
                for c in itertools.combinations(tokens(r["url"]), k):
                    count[c] += 1
                    ill[c] += bad
    least = max(0.8, 1.2 * n_bad / n)
    rules = {c: ill[c] / count[c] for c in count if ill[c] >= 20 and ill[c] / count[c] >= least}
    rules = {c: x for c, x in rules.items() if not any(set(d) < set(c) and y >= x for d, y in rules.items())}
    assert rules
    blocked = 0
    for i, own in mine.items():
        want = max(((x, " ".join(c)) for c, x in rules.items() if set(c) <= own), default=(0, None))[1]
        assert (got[i]["mined"], got[i]["verdict"]) == (want, "block" if want else "allow")
        blocked += want is not None
    assert blocked


def test_op8(spark, sf, docs):
    want = brute_components([(i, r["text"]) for i, r in docs.items()], 3, 85)
    got = {r["doc_id"]: r for r in queries.op8_near_dedup(spark, sf).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_op9(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, sf).collect()}
    assert set(got) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == docs[i]["lang"] for i in held) >= 0.95 * len(held)
    # a plain greedy parse of the same samples, for texts that it can do in time
    learnt = spark.read.parquet(f"{sf}/documents.parquet").where(language.fold() != 0)
    samples = language.fit(learnt)
    for i, r in docs.items():
        if i % 3 or len(r["text"] or "") > 2000:
            continue
        if not any(map(str.isalpha, r["text"] or "")):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        parts = brute.stretches(brute.classes(r["text"]))
        bits = sorted((sum(brute.phrases(x, known) for x in parts) * math.log2(len(known)), name) for name, known in samples.items())
        assert got[i]["lang_pred"] == bits[0][1]
        assert got[i]["score"] == pytest.approx(1 - bits[0][0] / bits[1][0])


def test_op10(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op10_lm_score(spark, sf).collect()}
    tokens = {i: [*words(low(r["text"])), None] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n = sum(count.values())
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (len(count) + 1))) for w in t), rel=1e-9)
    size = {i: len((r["text"] or "").encode()) + 1 for i, r in docs.items()}
    bits = -sum(got[i]["score"] for i in docs if held[i]) * math.log2(10) / sum(size[i] for i in docs if held[i])
    assert 0 < bits < 3  # a uniform byte takes eight
