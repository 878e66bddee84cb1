import random

import xxhash

from revlens.llm.components import components
from revlens.llm.simhash_bktree import (
    BKTree,
    fingerprints,
    keep_one,
    links,
    near_duplicates,
    shard_stars,
    simhash,
)


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius):
    """The smallest value that each value reaches."""
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    order = sorted(values)
    for i, a in enumerate(order):
        for b in order[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {v: top(v) for v in values}


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def near_values(rng, n, groups):
    out = set()
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(n // groups):
            v = centre
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64)
            out.add(signed(v))
    return sorted(out)


def test_fingerprint():
    for text in ("", "a", "a b", "A b  c", "x\ty\x0bz x y z x y", "É é x y", "one two three four " * 40):
        assert simhash(text) & (2**64 - 1) == brute_fingerprint(text)


def test_tree_follows_edges_within_the_radius():
    rng = random.Random(3)
    values = [v & (2**64 - 1) for v in near_values(rng, 300, 4)]
    tree = BKTree()
    for v in values:
        tree.insert(v)
    for q in values[:60]:
        want = {v for v in values if (v ^ q).bit_count() <= 2}
        assert {tree.values[i] for i in tree.within(q, 2)} == want
    assert list(BKTree().within(5, 2)) == []


def test_shard_stars_span_the_links():
    values = near_values(random.Random(4), 200, 3)
    want = brute_components(values, 2)
    top = {a: a for a in values} | dict(shard_stars(values, 2))
    groups = lambda m: sorted(sorted(v for v in values if m[v] == r) for r in set(m.values()))
    assert groups(top) == groups(want)


def test_links_with_small_trees(spark):
    """Hot shards parted again and again lose no link."""
    values = near_values(random.Random(6), 240, 3)
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = {r.node: r.root for r in components(links(frame, 2, limit=30)).collect()}
    want = brute_components(values, 2)
    size = {r: sum(x == r for x in want.values()) for r in set(want.values())}
    assert found == {v: r for v, r in want.items() if size[r] > 1}


def test_components_of_a_long_path_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {i: signed(brute_fingerprint(t)) for i, t in texts.items()}
    roots = brute_components(set(prints.values()), 2)
    least = {}
    for i, v in prints.items():
        least[roots[v]] = min(i, least.get(roots[v], i))
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert int(r.fingerprint, 16) == prints[r.doc_id] & (2**64 - 1)
        assert len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower()
        assert r.component_id == least[roots[prints[r.doc_id]]]
    kept = sorted(r.doc_id for r in keep_one(docs).collect())
    assert kept == sorted(least.values())


def test_edge_cases(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = {(r.doc_id, r.component_id) for r in rows if int(r.fingerprint, 16) == 0}
    assert zero == {(1, 1), (2, 1), (3, 1), (None, 1)}
    alone = [r for r in rows if r.doc_id is None and int(r.fingerprint, 16)]
    assert [r.component_id for r in alone] == [None]
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert len(got) == len(set(got))
    assert [g[:2] for g in got] == [(False, i) for i in (0, 0, 1, 4, 5, 6)] + [(True, 0)]
    assert near_duplicates(no_docs).count() == 0
    assert keep_one(no_docs).count() == 0
    assert fingerprints(no_docs, {}, no_docs["text"]).count() == 0
