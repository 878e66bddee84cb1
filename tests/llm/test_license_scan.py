import re

from revlens.llm.license_scan import BASE, FUZZY, Searcher, license_report, license_scan, pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(text):
    """Base places by comparing words one by one."""
    words = WORD.findall(lower(text or ""))
    places = []
    for notice in BASE:
        phrase = notice.phrase.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                places.append((i, notice.label))
    return len(words), places


def test_pieces_cover_the_phrase():
    for notice in BASE + FUZZY:
        assert "".join(p for _, p in pieces(notice)) == notice.phrase
        assert len(pieces(notice)) == notice.max_edits + 1
        assert all(p for _, p in pieces(notice))


def test_base_places_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tricky = [
        "CC BY cc-by CC by by", "MIT License mit licenses mit  LICENSE", "gnu general public license " * 3,
        "Apache-License apache license", "licensed under the ccby", "é mit license é", "İMIT License",
    ]
    docs = docs.select("doc_id", "text").union(
        spark.createDataFrame([(-1 - i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    )
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in license_report(docs).collect():
        n_words, places = brute(texts[row.doc_id])
        at = [i for i, _ in places]
        assert row.n_words == n_words
        assert row.n_base == len(places)
        assert (row.first_word, row.last_word) == ((min(at), max(at)) if at else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1


def test_edited_notices_are_found_with_their_spans():
    text = "So: released under the GNU genral Public  Lisense, and under teh MIT Licence."
    _, (spans,) = Searcher(BASE + FUZZY).scan([text])
    by_label = {s["label"]: s for s in spans}
    assert by_label["gpl"]["text"] == "GNU genral Public  Lisense"
    assert text[by_label["gpl"]["start"] : by_label["gpl"]["end"]] == by_label["gpl"]["text"]
    assert by_label["gpl"]["edits"] == 2


def test_worse_places_before_a_better_one_stay():
    notice = next(n for n in FUZZY if n.max_edits)
    worse = notice.phrase[:2] + notice.phrase[3:]
    for places in ([worse, notice.phrase], [notice.phrase, worse], [worse, notice.phrase, worse], [worse] * 3):
        (spans,) = Searcher((notice,)).scan([" ".join(places)])[1]
        assert [s["text"] for s in spans] == places
        assert [s["edits"] for s in spans] == [int(p == worse) for p in places]


def test_too_many_edits_and_plain_prose_are_left():
    texts = ["the gnu herd in general lives on public land", "with license to roam", "a mitt"]
    assert Searcher(BASE + FUZZY).scan(texts)[1] == [[], [], []]


def test_seeds_miss_no_match_within_the_edits():
    """Every single-character edit of a phrase still has an untouched piece."""
    searcher = Searcher(FUZZY)
    for notice in FUZZY:
        for i in range(len(notice.phrase)):
            for edited in (notice.phrase[:i] + notice.phrase[i + 1 :], notice.phrase[:i] + "q" + notice.phrase[i + 1 :]):
                if edited.strip() != edited:
                    continue
                found = searcher.scan([f"x {edited} y"])[1][0]
                assert any(s["notice"] == notice.phrase for s in found), edited


def test_edge_cases(odd_docs, no_docs):
    rows = license_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert all(r.n_words == r.n_base == 0 and r.labels == "" and r.score == 0.0 for r in empty)
    assert license_report(no_docs).count() == 0
    assert license_scan(no_docs).columns == ["doc_id", "n_words", "spans"]
