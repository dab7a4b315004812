"""Exact dedup, fingerprints and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from checks import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__
from trajlens.llm import common, exact_dedup, fingerprints, ngram_join
from trajlens.llm.components import connected_components
from trajlens.llm.hashing import shingle_sets, word_hashes

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {" ".join(w)} - {""} if len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    """Smallest id reachable over links of at least 0.75, for rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    return [(key, len(sets[i]), min((k for k in groups[find(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows)]


def near_copies(n, length, seed, edits):
    """Texts that differ from one base in a few words each, so that some are linked only through others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(length)] = f"x{rng.randrange(40)}"
        yield i, " ".join(text)


def test_word_hashes_follow_words(monkeypatch):
    texts = ["A b\tc", None, "", "  x ", "q" * 300, "b a"]
    whole = word_hashes(pa.array(texts))
    monkeypatch.setattr("trajlens.llm.hashing.WINDOW", 7)
    cut = word_hashes(pa.array(texts))
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist() == [0, 3, 3, 3, 4, 5, 7]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("size", [1, 3, 2048])
def test_exact_groups_of_awkward_rows(awkward, size):
    found = sorted(map(repr, exact_dedup.exact_groups(awkward, size=size).drop("copies").collect()))
    rows = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in awkward.collect()]
    expected = []
    for key, text in rows:
        group = [k for k, t in rows if t == text]
        keep = max((k for k in group if k is not None), default=None)
        expected.append((key, keep, len(group), key == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert len(found) == len(expected)
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in exact_dedup.exact_groups(awkward, size=size).drop("copies").collect())


def test_blocks_whose_hash_collides_get_names_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(1).cast("long") if len(c) == 1 else exact_dedup.F.hash(*c).cast("long"))
    docs = spark.createDataFrame([(1, "aaab"), (2, "aaac"), (3, "aaab"), (4, "caaa")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs, size=2).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}


def test_one_row_of_each_group_stays(awkward):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    lowered = [(r["text"] or "").translate(LOWER) for r in kept.collect()]
    assert len(lowered) == len(set(lowered)) == len({(r["text"] or "").translate(LOWER) for r in awkward.collect()})
    assert exact_dedup.drop_exact_copies(awkward.limit(0)).count() == 0


def test_join_agrees_with_brute_force_on_near_copies(spark, monkeypatch):
    rows = [*near_copies(60, 80, 1, 6), *[(100 + i, t) for i, t in near_copies(25, 12, 2, 3)], (200, "a b"), (201, "A  b"), (202, "a")]
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(300 + i, shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(8 + 4 * i))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "PACK_SHINGLES", 700)
    monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "DEALT_ROWS", 50)
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    found = [tuple(r)[:3] for r in ngram_join.similar_documents(docs).collect()]
    assert sorted(found) == sorted(brute_components(rows))


def test_heads_of_linked_sets_share_enough():
    rng = random.Random(9)
    for _ in range(4000):
        common, own, other = rng.randrange(1, 60), rng.randrange(25), rng.randrange(25)
        if 100 * common < 75 * (common + own + other):
            continue
        numbers = rng.sample(range(10**6), common + own + other)
        one, two = sorted(numbers[: common + own]), sorted(numbers[:common] + numbers[common + own :])
        (a, need_a), (b, need_b) = ngram_join._head(len(one), 75), ngram_join._head(len(two), 75)
        assert len(set(one[:a]) & set(two[:b])) >= max(need_a, need_b)


def test_join_tells_sets_with_one_digest_apart(spark, monkeypatch):
    whole = ngram_join._node

    def by_size(shingles):
        return len(shingles), whole(shingles)[1]

    rows = [*near_copies(40, 40, 5, 3), *[(100 + i, t) for i, t in near_copies(40, 40, 6, 3)], (200, "a b"), (201, "c"), (202, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "_node", by_size)
    monkeypatch.setattr(ngram_join, "_name", lambda s, clashing: by_size(s)[1 if len(s) in clashing else 0])
    found = [tuple(r)[:3] for r in ngram_join.similar_documents(docs).collect()]
    assert sorted(found) == sorted(brute_components(rows))


def test_join_of_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = [tuple(r)[:3] for r in ngram_join.similar_documents(awkward).collect()]
    assert sorted(found, key=repr) == sorted(brute_components(rows), key=repr)
    kept = ngram_join.keep_one_of_similar(awkward)
    assert kept.columns == awkward.columns and {1, 3, 4, 5, 7, 8} <= {r["doc_id"] for r in kept.collect()}
    assert 2 not in {r["doc_id"] for r in kept.collect()}
    assert ngram_join.similar_documents(awkward.limit(0)).count() == 0


def test_rows_are_dropped_by_id_and_text(spark):
    """Null ids match each other; the other texts of an id stay, and so do equal texts of other ids."""
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None), (3, None), (3, "")], "doc_id long, text string")
    gone = docs.where("doc_id = 1 AND text = 'a' OR doc_id IS NULL AND text = 'a' OR doc_id = 3 AND text = ''")
    left = common.without(docs, gone.select("doc_id", common.text_key(F.col("text")).alias("text_key")), "doc_id", "text")
    assert sorted(left.collect(), key=str) == sorted([(1, "b"), (2, "a"), (None, None)], key=str)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Cross" not in plan


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, i) for i in range(51, 60)] + [(7, 7), (70, 71), (71, 70), (None, 3)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(map(tuple, found)) == {**{i: 0 for i in range(21)}, **{i: 50 for i in range(50, 60)}, 70: 70, 71: 70}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_agree_with_the_rule(spark, texts):
    rows = sorted(texts.items(), reverse=True)
    minhash = fingerprints.MinHash()
    signed = [minhash(s) for s in shingle_sets(pa.array([t for _, t in rows]))]
    found = {r["doc_id"]: r for r in __spark_entry__.queries()["op6_fingerprints"](spark, SF_DIR).collect()}
    for i, (key, text) in enumerate(rows):
        after, half, r = rows[(i + 1) % len(rows)][1], len(text) // 2, found[key]
        edited = text[: len(text) - half] + after[:half]
        (other,) = (minhash(s) for s in shingle_sets(pa.array([edited])))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert r["fingerprint"] == fingerprints.as_text(signed[i]) and r["edited_fingerprint"] == fingerprints.as_text(other)
        assert r["near_edited"] == fingerprints.likeness(signed[i], other)
        assert r["near_next"] == fingerprints.likeness(signed[i], signed[(i + 1) % len(rows)])


def test_likeness_is_near_the_jaccard_similarity():
    one, two = " ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(60, 460))
    minhash = fingerprints.MinHash()
    a, b = (minhash(s) for s in shingle_sets(pa.array([one, two])))
    true = len(shingles(one) & shingles(two)) / len(shingles(one) | shingles(two))
    assert abs(fingerprints.likeness(a, b) - true) < 0.15


def test_fingerprints_of_awkward_rows(spark, awkward):
    found = fingerprints.edited_fingerprints(awkward).collect()
    assert len(found) == awkward.count() and all(0 <= r["near_next"] <= 1 for r in found)
    alone = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(awkward.limit(0)).count() == 0


def test_near_duplicates_are_verified(spark):
    rows = [*near_copies(20, 200, 5, 2), (100, "a b"), (101, "A B"), (102, None), (103, "entirely different words stand in this text")]
    classes = dict(map(tuple, fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert {classes[i] for i in range(20)} == {0}
    assert (classes[100], classes[101], classes[102], classes[103]) == (100, 100, 102, 103)


@pytest.mark.parametrize("block", [1000, 7])
def test_near_duplicates_behind_unlike_smaller_ids_are_found(spark, monkeypatch, block):
    """Forty smaller ids below the similarity hold all bands that a linked pair shares."""
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(204)]

    def edited(places, tag):
        text = list(base)
        for at in places:
            text[at] = f"{tag}x{at}"
        return " ".join(text)

    rows = [(i, edited(rng.sample(range(10, 190, 6), 6), i)) for i in range(40)]
    rows += [(40, edited([20, 80], 40)), (41, edited([50, 110], 41)), (42, edited([50, 110], 41)), (43, None)]
    classes = dict(map(tuple, fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    expected = {key: 43 if key == 43 else least for key, _, least in brute_components(rows)}
    assert expected[41] == 40 and len(set(expected.values())) > 30
    assert classes == expected
