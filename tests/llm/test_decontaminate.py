import collections
import hashlib
import random
import re

from revlens.llm.decontaminate import contamination_report, drop_contaminated, find_benchmark
from revlens.llm.sizes import BROADCAST_BYTES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for item_id, item_text in items:
        item = words(item_text)
        k = min(13, len(item))
        grams = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        for p in range(len(doc) - k + 1 if k else 0):
            if tuple(doc[p : p + k]) in grams:
                hit |= {*range(p, p + k)}
                found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(doc), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(doc)


def test_against_all_windows(spark):
    rng = random.Random(8)
    vocabulary = [*"abcdefgh", "É", "été", "zz", "9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 13, 14, 30))))) for i in range(2, 14)]
    items += [(10, "a a a a a a a a a a a a a a a"), (100, "x-y, Z"), (101, ""), (102, None), (3, "n o p")]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))]
        if i % 3 == 0:
            item = words(rng.choice(items)[1])
            cut = rng.randint(0, max(0, len(item) - 13))
            parts += [", ".join(item[cut:]).upper(), " ".join(rng.choices(vocabulary, k=rng.randint(0, 300)))]
        docs.append((i, " \n".join(parts)))
    docs += [(500, docs[0][1]), (500, docs[0][1]), (500, docs[3][1]), (None, docs[6][1]), (501, "x y z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "a b c")], "item_id long, text string")
    got = sorted(
        repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
        for r in contamination_report(frame, bench).collect()
    )
    assert got == sorted(repr((i, *brute(t, items))) for i, t in docs)
    kept = sorted(repr(tuple(r)) for r in drop_contaminated(frame, bench).collect())
    assert kept == sorted(repr((i, t)) for i, t in docs if not brute(t, items)[-1])


def near_places(docs, items):
    """Proximity matches by trying every anchor offset of every item in every text."""
    texts, wanted, found = [words(t) for _, t in docs], {}, []
    counts = collections.Counter(w for t in texts for w in t)
    for item_id, item_text in items:
        item = words(item_text)
        k, places = min(13, len(item)), set()
        for s in range(len(item) - k + 1 if k else 0):
            seen = sorted((counts[item[j]], j) for j in range(s, s + k) if counts[item[j]])
            places |= {j for _, j in seen[:3]} if 100 * len(seen) >= 75 * k else set()
        if item_id is not None and k:
            wanted[item_id, tuple(item)] = (k, places)
    for text in texts:
        first = {}
        for (item_id, item), (k, places) in wanted.items():
            offsets = [q - p for p in places for q, x in enumerate(text) if x == item[p]]
            for o in set(offsets):
                if sum(abs(o - x) <= 13 for x in offsets) < min(3, k):
                    continue
                close = [item[j] in text[max(0, o + j - 13) : max(0, o + j + 14)] for j in range(len(item))]
                for s in range(len(item) - k + 1):
                    if 100 * sum(close[s : s + k]) >= 75 * k:
                        first[item_id] = min(first.get(item_id, o + s), o + s)
        found.append((len(first), ",".join(sorted(f"{i}:{at}" for i, at in first.items()))))
    return found


def edited(rng, item):
    out = [w for w in item if rng.random() > 0.08]
    out.insert(rng.randint(0, len(out)), "quite")
    return " ".join(out)


def test_proximity_against_every_offset(spark, shuffled):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 4, 13, 20, 45)))) for _ in range(24)]
    items = [*enumerate(texts), (3, "w1 w2 w3 w4"), (40, f"{texts[5]} absent words"), (None, texts[0])]
    docs = []
    for i in range(60):
        item = words(items[i % 24][1])
        start = rng.randint(0, len(item) // 2)
        filler = rng.choices(vocabulary, k=rng.randint(0, 60))
        docs.append((i, " ".join([*filler, edited(rng, item[start:]), *rng.choices(vocabulary, k=20)])))
    docs += [(60, docs[4][1]), (61, docs[4][1]), (61, docs[4][1]), (62, None), (63, texts[3])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = sorted((i, *near) for (i, _), near in zip(docs, near_places(docs, items), strict=True))
    for limit in (BROADCAST_BYTES, 0):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if limit else "-1")
        rows = contamination_report(frame, bench, limit).collect()
        assert sorted((r.doc_id, r.n_near, r.near_items) for r in rows) == wanted
        assert sorted((r.doc_id, r.n_hit, r.n_items, r.items_sha256) for r in rows) == sorted(
            (i, *brute(t, [x for x in items if x[0] is not None])[1:4]) for i, t in docs
        )
    assert sum(n for _, n, _ in wanted) > 30


def test_shuffled_joins_deal_a_word_that_is_everywhere(spark, shuffled):
    docs = [(i, "the " * 3000 + f"red fox {i} jumps") for i in range(8)]
    items = [(1, "the red fox"), (2, "the"), (3, "7 jumps")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination_report(frame, bench, 0).collect()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == [(i, *brute(t, items)) for i, t in docs]


def test_proximity_matches_need_no_exact_phrase(spark):
    passage = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar"
    loose = passage.replace(" delta", " delta quite").replace(" kilo", "")
    docs = [(1, f"so {loose} end"), (2, "alpha is far from oscar"), (3, passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    rows = {r.doc_id: r for r in find_benchmark(frame, bench).collect()}
    assert rows[1].n_hit == 0 and [n.item_id for n in rows[1].near] == [7]
    assert rows[3].n_hit == 15 and rows[3].matched == [7] and rows[3].n_words == 15
    assert 2 not in rows


def test_edge_cases(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "One plain TEXT of a few words", 3)], "item_id long, text string, at int")
    rows = contamination_report(odd_docs, bench).collect()
    assert sorted((r.doc_id, r.n_hit) for r in rows if r.n_hit) == [(0, 7), (0, 7)]
    kept = drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert contamination_report(no_docs, bench).count() == 0
    nothing = contamination_report(odd_docs, bench.limit(0)).collect()
    assert len(nothing) == odd_docs.count() and not any(r.contaminated for r in nothing)
