"""Ranked search, source divergence and line dedup against brute force and awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trajlens.llm import divergence, line_dedup, ranked_search, word_runs
from trajlens.llm.hashing import text_bytes

LOWER = {i: i + 32 for i in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def random_texts(n, seed, vocabulary=60, most=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéß你") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(vocabulary)]
    pick = lambda: words[min(int(rng.expovariate(0.08)), vocabulary - 1)]
    return [rng.choice([" ", ", ", "\n"]).join(pick() for _ in range(rng.randrange(most))) for _ in range(n)]


# Ranked search


def brute_search(docs, items, top):
    said = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    sizes = [sum(c.values()) for c in said]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item_id, text in set(items):
        wanted, scores = Counter(TERM.findall((text or "").translate(LOWER))), []
        for (doc_id, _), counts, size in zip(docs, said, sizes):
            score = 0
            for term, times in wanted.items():
                if tf := counts[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(term in c for c in said) + 1)))
                    score += times * w * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * size * n // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_search_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ranked_search, "SEED_SHARE", 4)
    texts = random_texts(300, seed)
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(5, texts[9]), (4, texts[9]), (4, texts[9])]
    items = [(i // 2, t) for i, t in enumerate(random_texts(30, seed, most=12))] + [(99, None), (98, "unheard of"), (0, "a")]
    frames = (spark.createDataFrame(rows, f"{key} long, text string") for rows, key in ((docs, "doc_id"), (items, "item_id")))
    found = ranked_search.ranked_documents(*frames, top=5)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_search(docs, items, 5)


def test_more_items_than_one_batch_holds(spark):
    docs = list(enumerate(random_texts(120, 3)))
    items = list(enumerate(random_texts(25, 3, most=12)))
    frames = (spark.createDataFrame(rows, f"{key} long, text string") for rows, key in ((docs, "doc_id"), (items, "item_id")))
    found = ranked_search.ranked_documents(*frames, top=4, batch_terms=40)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_search(docs, items, 4)


def test_dual_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    items = [{int(t): int(rng.integers(1, 9000)) for t in rng.choice(np.arange(i // 20 * 30, i // 20 * 30 + 30), 6, replace=False)} for i in range(100)]
    nodes = ranked_search.item_tree(items)
    rows = [sorted(set(rng.integers(t := rng.integers(0, 5) * 30, t + 30, 12).tolist())) for _ in range(1000)]
    doc = np.repeat(np.arange(1000), [len(r) for r in rows])
    terms, values = np.concatenate(rows), rng.integers(1, 1_000_000, len(doc))
    block = ranked_search.Block(doc, terms, values, 1000)
    dense = np.zeros((1000, 150), np.int64)
    dense[doc, terms] = values
    scores = [dense[:, list(item)] @ np.array(list(item.values())) for item in items]
    for node in nodes:
        assert all(block.bound(node) >= scores[i].max() for i in node.items)
    search = ranked_search.Search(100, np.zeros(100, np.int64), 3)
    search.block(nodes, block, list(range(1000)), list(range(1000)))
    for i, found in enumerate(search.found):
        best = sorted((-int(s), d) for d, s in enumerate(scores[i]) if s > 0)[:3]
        assert [(r[0], r[2]) for r in found] == best
    # With the floors known from before, most pairs end at a bound, and what is found is the same.
    again = ranked_search.Search(100, search.floors.copy(), 3)
    again.block(nodes, block, list(range(1000)), list(range(1000)))
    assert again.found == search.found and again.scored < 100 * 1000 / 2


def test_ranked_search_of_awkward_rows(spark, awkward):
    items = awkward.selectExpr("doc_id AS item_id", "text", "n_chars AS term", "n_chars AS item")
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = ranked_search.ranked_documents(awkward, items, top=3)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_search(rows, rows, 3)
    assert ranked_search.ranked_documents(awkward.limit(0), items).count() == 0
    assert ranked_search.ranked_documents(awkward, items.limit(0)).count() == 0


# Word runs and divergence


@pytest.mark.parametrize("small", [4, 1 << 15])
def test_pointer_sort_follows_words(small):
    texts = random_texts(80, 4) + ["", None, "Ab aB ABC abcdefgh abcdefghi abcdefgh", "x" * 50 + " " + "x" * 50, "a1b-c"]
    words = word_runs.words_in(*text_bytes(pa.array(texts)))
    order, begins = word_runs.sorted_runs(words, np.arange(len(words.starts)), small)
    said = [bytes(words.data[s : s + n]) for s, n in zip(words.starts, words.sizes)]
    assert [w.decode() for w in said] == [w for t in texts for w in LETTERS.findall((t or "").translate(LOWER))]
    assert order.tolist() == sorted(range(len(said)), key=lambda i: (said[i], i))
    assert begins.tolist() == [i == 0 or said[order[i]] != said[order[i - 1]] for i in range(len(order))]


def test_group_runs_count_words_and_texts():
    texts = ["a b a", "b", "A c", ""]
    terms, group, n, held = word_runs.group_runs(*text_bytes(pa.array(texts)), np.array([1, 0, 1, 0], np.uint16))
    assert sorted(zip(terms.to_pylist(), group.tolist(), n.tolist(), held.tolist())) == [
        ("a", 1, 3, 2), ("b", 0, 1, 1), ("b", 1, 1, 1), ("c", 1, 1, 1),
    ]


def brute_divergence(rows, min_docs, most):
    said = defaultdict(lambda: defaultdict(Counter))
    held = defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", LETTERS.findall((text or "").translate(LOWER))
        said[lang][source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in said.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        shares = {s: share(c) for s, c in sources.items()}
        whole = share(sum(sources.values(), Counter()))
        for s, p in shares.items():
            pairs = [(-sum(apart(p[t], q[t]) for t in kept), o.encode()) for o, q in shares.items() if o != s]
            terms = [(-apart(p[t], whole[t]), t.encode()) for t in kept if sources[s][t] and p[t] > whole[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("blocks", [2, 200])
def test_divergence_by_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(divergence.source_pairs, "__defaults__", (30, blocks))
    monkeypatch.setattr(divergence.term_counts, "__defaults__", ("text", "lang", "source", 300))
    rng = random.Random(6)
    rows = [(t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", "x", None])) for t in random_texts(200, 6, 90)]
    rows += [("", "xx", "p"), (None, "xx", "q"), ("rare", "xx", None), ("", "yy", "alone")]
    found = divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=4)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_divergence(rows, 4, 10)


def test_divergence_of_awkward_rows(spark, awkward):
    extra = awkward.selectExpr("*", "n_chars AS term", "n_chars AS share", "n_chars AS n")
    rows = [(r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    found = divergence.source_divergence(extra, min_docs=1)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_divergence(rows, 1, 10)
    assert divergence.source_divergence(awkward.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    big = 10**17
    row = spark.range(1).selectExpr(f"{big}L AS c", f"{3 * big}L AS t", "5L AS v")
    found = row.select(divergence._share(*(row[c] for c in "ctv"))).first()[0]
    assert found == 1 + 10**9 * (big + 2) // (3 * big + 10)


# Lines


def brute_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    order = lambda d: (d is None, d or 0)
    first = {}
    for doc_id, text in sorted(rows, key=lambda r: order(r[0])):
        for line in (text or "").split("\n"):
            first.setdefault(key(line), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("common", [3, 1_000])
def test_lines_by_brute_force(spark, common, monkeypatch):
    """With the small limit, lines above it are decided from exact counts; else all are streamed."""
    monkeypatch.setattr(line_dedup, "COMMON_LINES", common)
    monkeypatch.setattr(line_dedup, "SLICES_PER_PARTITION", 64)
    rng = random.Random(8)
    lines = [f"{'Shared' if i % 2 else ' shared'} line number {i} " for i in range(40)] + ["short", "", "\t", "ABCDEFGHIJ", "abcdefghij\r"]
    pick = lambda: lines[min(int(rng.expovariate(0.2)), len(lines) - 1)]
    rows = [(rng.choice([None, i, i, i, 7]), "\n".join(pick() for _ in range(rng.choice([0, 1, 3, 130])))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = line_dedup.drop_repeated_lines(docs)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_lines(rows)


def test_lines_of_awkward_rows(spark, awkward):
    extra = awkward.selectExpr("*", "n_chars AS hi", "n_chars AS t1", "n_chars AS n_lines", "n_chars AS _lines", "n_chars AS first")
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = line_dedup.drop_repeated_lines(extra)
    assert found.columns == [*extra.columns, "_n_lines", "n_dropped"]
    assert sorted(repr(tuple(r)) for r in found.select("doc_id", "text", "_n_lines", "n_dropped").collect()) == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(awkward.limit(0)).count() == 0


def test_bitmaps_leave_out_words_without_drops(spark):
    text = "\n".join(f"line of its own {i}" for i in range(200))
    docs = spark.createDataFrame([(1, "line of its own 130"), (2, text)], "doc_id long, text string")
    maps = line_dedup.line_bitmaps(docs).collect()
    assert [(r["doc"], r["n_dropped"], [tuple(w) for w in r["dropped"]]) for r in maps] == [(2, 1, [(2, 1 << 2)])]


def test_line_hashes_are_sorted_in_ranges_without_another_shuffle(spark):
    docs = spark.createDataFrame([(i, f"a line of text {i}\nanother line {i}") for i in range(50)], "doc_id long, text string")
    listed = line_dedup._listed(docs, "doc_id", "text", 10)
    plan = line_dedup.dropped_lines(listed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(hi" not in plan


def test_digest_of_query(spark):
    from checks import SF_DIR
    from trajlens.llm.queries import op13_line_dedup

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    kept = {eval(r)[0]: eval(r)[1] for r in brute_lines([tuple(d) for d in docs])}
    for row in op13_line_dedup(spark, SF_DIR).collect():
        assert row["kept_sha256"] == hashlib.sha256(kept[row["doc_id"]].encode()).hexdigest()
