import hashlib
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from revlens.llm.mixing import budgets, corpus_levels, mix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEVELS = ["domain", "lang", "source"]


def share(children, budget):
    """{name: (weight, capacity)} -> {name: tokens}: fill what is short, deal out the rest."""
    got, open_ = {}, {n: wc for n, wc in children.items() if wc[0] > 0 and wc[1] > 0}
    left = budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c <= Fraction(left * w, total)]
        if not full:
            break
        n = min(full, key=lambda n: (Fraction(open_[n][1], open_[n][0]), n))
        got[n] = open_[n][1]
        left -= got[n]
        del open_[n]
    total = sum(w for w, _ in open_.values())
    return got | {n: left * w // total for n, (w, _) in open_.items()}


def usable(leaf, weights):
    """Whether nothing on the way to a leaf weighs nothing."""
    return all(weights.get(level, {}).get(value, 1) > 0 for level, value in zip(LEVELS, leaf, strict=True))


def brute_budgets(leaves, weights, percent, epochs):
    """leaves: {(domain, lang, source): tokens}."""
    out = {(): sum(leaves.values()) * percent // 100}
    for depth in range(1, 4):
        new = {}
        for parent, budget in out.items():
            capacity = defaultdict(int)
            for leaf, tokens in leaves.items():
                if leaf[: depth - 1] == parent:
                    capacity[leaf[depth - 1]] += tokens * epochs * usable(leaf, weights)
            weight = weights.get(LEVELS[depth - 1], {})
            kids = {n: (weight.get(n, 1), c) for n, c in capacity.items()}
            new |= {(*parent, n): b for n, b in share(kids, budget).items()}
        out = new
    return out


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = {
        ("a", "en", "s1"): 100, ("a", "en", "s2"): 5000, ("a", "fr", "s3"): 10, ("b", "en", "s4"): 700,
        ("b", "de", "s5"): 90, ("c", "en", "s6"): 40,
    }
    frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    heavy = {"domain": {"a": 5, "c": 4}, "lang": {"fr": 9}}
    for weights, percent, epochs in (
        ({}, 60, 2), (heavy, 10, 1), (heavy, 500, 2), ({"domain": {"b": 0}}, 90, 1), ({}, 0, 1),
    ):
        got = budgets(frame, LEVELS, weights, 1, percent, epochs)
        got = {(r.domain, r.lang, r.source): r.budget for r in got.collect()}
        want = brute_budgets(leaves, weights, percent, epochs)
        assert got == want, (weights, percent, epochs)
        assert all(b <= leaves[leaf] * epochs for leaf, b in got.items())


def test_what_a_weight_of_nothing_leaves_out_is_given_elsewhere(spark):
    leaves = {("a", "en", "s1"): 1000, ("a", "fr", "s2"): 10, ("b", "en", "s3"): 10, ("b", "fr", "s4"): 5000}
    frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    for zero in ({"domain": {"a": 0}}, {"lang": {"en": 0}}, {"source": {"s4": 0}}, {"lang": {"en": 0, "fr": 0}}):
        for percent in (50, 90):
            got = budgets(frame, LEVELS, zero, 1, percent, 1).collect()
            given = sum(r.budget for r in got)
            room = sum(t for leaf, t in leaves.items() if usable(leaf, zero))
            wanted = sum(leaves.values()) * percent // 100
            assert min(wanted, room) - 7 <= given <= min(wanted, room), (zero, percent)  # a token a node
            assert {(r.domain, r.lang, r.source): r.budget for r in got} == brute_budgets(leaves, zero, percent, 1)


def brute_mix(docs, weights, percent, epochs, seed):
    rows, leaves = [], defaultdict(int)
    for doc_id, text, lang, source in docs:
        number = re.search("[0-9]+", source or "")
        domain = f"domain{int(number[0]) // 5}" if number else source
        leaf = tuple(x if x is not None else "(none)" for x in (domain, lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        n = len(WORD.findall(low))
        if n:
            leaves[leaf] += n
            rows.append((leaf, doc_id, n, hashlib.md5((text or "").encode()).hexdigest()))
    given = brute_budgets(leaves, weights, percent, epochs)
    out = []
    for leaf, budget in given.items():
        whole, part = divmod(budget, leaves[leaf])
        keyed = defaultdict(list)
        for at, doc_id, n, h in rows:
            if at == leaf:
                key = f"{seed}:{whole}:{'' if doc_id is None else doc_id}:{h}"
                keyed[hashlib.md5(key.encode()).hexdigest()].append((doc_id, n))
        used, ended = 0, False
        for key in sorted(keyed):
            used += sum(n for _, n in keyed[key])
            ended = ended or used > part
            for doc_id, n in keyed[key]:
                if whole + (not ended):
                    out.append((doc_id, *leaf, n, whole + (not ended)))
    return out


def test_selection_against_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(None, "no id here", None, None), (7, "again", "en", "src3"), (7, "again", "en", "src3")]
    frame = spark.createDataFrame(rows, docs.schema)
    weights = {"domain": {"domain1": 5}, "lang": {"es": 30}}
    for percent, epochs in ((40, 1), (110, 3)):
        got = mix(frame, corpus_levels(), weights, 1, percent, epochs, seed="t")
        got = got.select("doc_id", "mix_domain", "mix_lang", "mix_source", "n_tokens", "copies")
        want = brute_mix(rows, weights, percent, epochs, "t")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_selection_beyond_the_size_check(spark, sf, shuffled):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    got = mix(docs, corpus_levels(), {}, 1, 110, 3, seed="t")
    got = got.select("doc_id", "mix_domain", "mix_lang", "mix_source", "n_tokens", "copies")
    want = brute_mix([tuple(r) for r in docs.collect()], {}, 110, 3, "t")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_edge_cases(odd_docs, no_docs):
    got = mix(odd_docs, corpus_levels(), {}, 1, 1000, 2)
    assert [c for c in got.columns if c in odd_docs.columns] == [
        c for c in odd_docs.columns if c not in ("n_tokens", "copies")
    ] + ["n_tokens", "copies"]
    rows = got.collect()
    assert {r.copies for r in rows} == {2}  # a budget beyond all capacity takes all of it
    assert not {1, 2, 3} & {r.doc_id for r in rows}
    assert sum(r.n_tokens > 0 for r in rows) == len(rows) == odd_docs.count() - 4
    assert mix(no_docs, corpus_levels()).count() == 0
    assert mix(odd_docs, {"lang": F.col("lang")}, {"lang": {"en": 0}}, 1, 100, 1).filter("lang = 'en'").count() == 0
